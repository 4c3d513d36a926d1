"""Registered queries over findings as intervals and over rules that users bring; each with its DuckDB SQL."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from palisade.functions import validators
from palisade.operators import globs, redact, rule_documents, scan, spans
from palisade.plans.rules import load
from palisade.queries import _BOTH, _CARD_RE, _CARDS, _DIRS, _IP_RE, _LUHN, _NAMES, _NOT_TEST, _PUBLIC, ANY_CARD, CARD, IPV4, _both, _ip_sql, _matches_sql, query, spread, table

#: Rules as a user brings them: a group in the middle, one that is nested, one that may be absent.
DOCUMENT = r"""{"rules": [
  {"id": "own-token", "family": "credential", "description": "assigned token", "enabled": true, "regex": "token = \"([0-9a-f]{40})\"", "group": 1, "keywords": ["token"]},
  {"id": "own-octet", "family": "pii", "description": "third octet", "enabled": true, "regex": "\\b(?:\\d{1,3}\\.){2}(?:(\\d{1,3})\\.)\\d{1,3}\\b", "group": 1},
  {"id": "own-tail", "family": "pii", "description": "last four digits, where they stand apart", "enabled": true, "regex": "\\b(?:\\d{4}[ -]?){3}(?:\\b(\\d{4})|\\d{1,4})\\b", "group": 1}
]}"""


@lru_cache(maxsize=1)
def own_rules():
    return load(DOCUMENT)


_TOKENS = f"""SELECT doc_id, 'own-token' AS rule_id, "offset" + 9 AS "offset", substr(value, 10, 40) AS value FROM ({_matches_sql("documents", "doc_id", "text", 'token = "[0-9a-f]{40}"')})"""
_OCTETS = f"""SELECT doc_id, 'own-octet' AS rule_id, "offset" + strlen(string_split(value, '.')[1]) + strlen(string_split(value, '.')[2]) + 2 AS "offset", string_split(value, '.')[3] AS value
  FROM ({_matches_sql("documents", "doc_id", "text", _IP_RE)})"""
_TAILS = rf"""SELECT doc_id, 'own-tail' AS rule_id, "offset" + strlen(value) - 4 AS "offset", right(value, 4) AS value FROM ({_matches_sql("documents", "doc_id", "text", _CARD_RE)})
  WHERE regexp_full_match(value, '\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]\d{{4}}')"""


@query(f"""SELECT doc_id, rule_id, "offset"::BIGINT AS "offset", ("offset" + strlen(value))::BIGINT AS "end", substr(sha256(rule_id || chr(0) || value), 1, 16) AS digest
  FROM ({_TOKENS} UNION ALL {_OCTETS} UNION ALL {_TAILS})""")  # fmt: skip
def loaded_rule_groups(spark, sf_dir):
    """Rules given as a document: what their groups capture, wherever it lies in the match, or nothing where it is absent."""
    return scan.findings(table(spark, sf_dir, "documents"), "doc_id", "text", own_rules())


@query("""SELECT doc_id, strlen(r) AS n_bytes, sha256(r) AS redacted_sha256 FROM (
  SELECT doc_id, regexp_replace(text, 'token = "[0-9a-f]{40}"', 'token = "[REDACTED:own-token]"', 'g') AS r FROM documents)""")
def loaded_rule_redacted(spark, sf_dir):
    """A group in the middle of its match is hidden whole, and nothing around it."""
    out = redact.redact(table(spark, sf_dir, "documents"), "doc_id", "text", [r for r in own_rules() if r.id == "own-token"])
    return out.select("doc_id", F.octet_length("redacted").cast("long").alias("n_bytes"), F.sha2("redacted", 256).alias("redacted_sha256"))


#: Every address and card number, unchecked, and two rules that meet them: pairs of octets, and long runs around them.
_ANY_IP, _ANY_CARD = replace(IPV4, validators=()), replace(CARD, validators=(), labels=())
_PAIR_RE, _LINE_RE = r"\b\d{2,3}\.\d{1,3}\b", r"\d{3}[A-Za-z ]{0,100}"
_PAIR, _LINE = replace(_ANY_IP, id="pair", regex=_PAIR_RE, group=0), replace(_ANY_IP, id="line", regex=_LINE_RE, group=0)


def _sides(*rules: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule_id, \"offset\" AS lo, \"offset\" + strlen(value) AS hi FROM ({_matches_sql('documents', 'doc_id', 'text', regex)})" for name, regex in rules)


@query(
    f"""WITH f AS ({_sides(("ipv4-public", _IP_RE), ("payment-card", _CARD_RE), ("pair", _PAIR_RE), ("line", _LINE_RE))})
    SELECT l.doc_id, l.rule_id AS left_rule, l.lo::BIGINT AS left_offset, r.rule_id AS right_rule, r.lo::BIGINT AS right_offset, (least(l.hi, r.hi) - greatest(l.lo, r.lo))::BIGINT AS shared
    FROM f l JOIN f r ON l.doc_id = r.doc_id AND l.rule_id < r.rule_id AND l.lo < r.hi AND r.lo < l.hi"""
)
def overlapping_findings(spark, sf_dir):
    """Findings of different rules that share bytes: a join of intervals, short and long."""
    found = scan.findings(table(spark, sf_dir, "documents"), "doc_id", "text", [_ANY_IP, _ANY_CARD, _PAIR, _LINE])
    met = spans.overlapping_rules(found, "doc_id")
    shared = F.least("left.end", "right.end") - F.greatest("left.offset", "right.offset")
    return met.select("doc_id", F.col("left.rule_id").alias("left_rule"), F.col("left.offset").alias("left_offset"), F.col("right.rule_id").alias("right_rule"), F.col("right.offset").alias("right_offset"), shared.alias("shared"))


@query(
    f"""WITH f AS ({_sides(("ipv4-public", _IP_RE), ("payment-card", _CARD_RE), ("pair", _PAIR_RE), ("line", _LINE_RE))}),
    g AS (SELECT *, CASE WHEN lo < max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM f),
    h AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT doc_id, min(lo)::BIGINT AS "offset", max(hi)::BIGINT AS "end", count(*) AS n FROM h GROUP BY doc_id, run"""
)
def covered_stretches(spark, sf_dir):
    """What the findings of a text cover together."""
    found = scan.findings(table(spark, sf_dir, "documents"), "doc_id", "text", [_ANY_IP, _ANY_CARD, _PAIR, _LINE])
    return spans.covered(found, "doc_id")




@query(
    rf"""WITH b AS (SELECT doc_id, 'ipv4-public' AS rule_id, "offset" AS lo, "end" AS hi FROM ({_PUBLIC}) UNION ALL SELECT doc_id, 'payment-card', "offset", "offset" + strlen(value) FROM ({_CARDS}) WHERE {_LUHN} AND {_NOT_TEST}),
    a AS ({_sides(("ipv4-public", _IP_RE))} UNION ALL SELECT doc_id, 'payment-card', "offset", "offset" + strlen(regexp_extract(value, '^\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}')) FROM ({_CARDS}))
    SELECT doc_id, rule_id, coalesce(a.lo, b.lo)::BIGINT AS "offset", coalesce(a.hi, b.hi)::BIGINT AS "end", CASE WHEN a.lo IS NULL THEN 'lost' WHEN b.lo IS NULL THEN 'gained' ELSE 'moved' END AS change
    FROM a FULL JOIN b USING (doc_id, rule_id, lo) WHERE a.hi IS DISTINCT FROM b.hi"""
)
def rule_set_changes(spark, sf_dir):
    """Another rule set: addresses without their check, and cards cut after their twelfth digit."""
    after = [_ANY_IP, replace(_ANY_CARD, regex=r"\b(\d{4}[ -]?\d{4}[ -]?\d{4})[ -]?\d{1,4}\b")]
    return spans.changes(table(spark, sf_dir, "documents"), "doc_id", "text", [IPV4, ANY_CARD], after)


@query(f"""SELECT source, count(DISTINCT rule_id || digest) AS different, true AS close FROM ({_BOTH}) JOIN documents USING (doc_id) GROUP BY 1""")
def distinct_values_sketched(spark, sf_dir):
    """Different values of each source, from sketches by source and language that are united; held against the count."""
    found = _both(spark, sf_dir, "source", "lang").withColumn("value", F.concat("rule_id", "digest"))
    about = spans.united(spans.sketched(found, ["source", "lang"], "value"), ["source"]).withColumnRenamed("different", "about")
    exact = found.groupBy("source").agg(F.count_distinct("value").alias("different"))
    near = F.abs(F.col("about") - F.col("different")) <= F.greatest(F.lit(1.0), 0.06 * F.col("different"))
    return exact.join(about, F.equal_null(exact["source"], about["source"])).select(exact["source"], "different", near.alias("close"))


_BUFFERS = "(SELECT conv_id, text || CASE WHEN conv_id % 4 = 0 AND turn = 1 THEN ' from 8.8.8.8' ELSE '' END AS text FROM conversations)"


@query(
    f"""WITH hit AS (SELECT DISTINCT conv_id FROM ({_ip_sql(_BUFFERS, "conv_id", "text")}) WHERE block IS NULL),
    call AS (SELECT conv_id, min(conv_id * 60 + turn) AS first FROM conversations GROUP BY 1), seen AS (SELECT max(conv_id * 60 + turn) - 60 AS to_ FROM conversations)
    SELECT conv_id AS call_id, CASE WHEN h IS NULL THEN CASE WHEN conv_id % 10 = 3 THEN 'abstain' ELSE 'allow' END WHEN conv_id % 8 = 0 THEN 'ask' ELSE 'deny' END AS verdict, h IS NULL AND conv_id % 10 = 3 AS expired
    FROM (SELECT call.conv_id, first, hit.conv_id AS h FROM call LEFT JOIN hit USING (conv_id)), seen WHERE h IS NOT NULL OR conv_id % 10 <> 3 OR first + 600 <= to_"""
)
def streamed_verdicts(spark, sf_dir):
    """Conversations as calls and turns as their buffers, streamed: an address decides at once; of every tenth call a
    buffer never comes, so that it expires, once the stream's time has passed its deadline."""
    from palisade.streaming.verdicts import finished, stream_verdicts

    rows = table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/conversations.parque[t]")  # a pattern, as the table may be one file
    parts = rows.groupBy("conv_id").agg(F.count("*").alias("n"))
    text = F.concat("text", F.when(F.expr("conv_id % 4 = 0 AND turn = 1"), " from 8.8.8.8").otherwise(""))
    buffers = stream.join(parts, "conv_id").select(
        F.col("conv_id").alias("call_id"), F.col("turn").alias("part"), F.expr("n + if(conv_id % 10 = 3, 1, 0)").alias("parts"), text.alias("text"),
        F.timestamp_seconds(F.expr("1767225600 + conv_id * 60 + turn")).alias("time"), F.when(F.expr("conv_id % 8 = 0"), "checked by hand").alias("override"),
    )
    return finished(stream_verdicts(buffers, which=[IPV4])).select("call_id", "verdict", "expired")


# ---- rules as data: documents that are wrong in one way each, and a check of one's own

_GOOD = {"id": "r", "family": "credential", "description": "d", "regex": r"\b(key_[a-z]{8})", "group": 1, "keywords": ["key_"], "enabled": True}
#: What is put in place of a part of the good rule (JSON text), and what the loader says then.
_BROKEN: tuple[tuple[str, str, str | None], ...] = (
    ('"d"', '"e"', None),
    ('"enabled": true', '"enable": true', "r: unknown field enable|r: enabled is missing: absent is not off"),
    ('"description": "d", ', "", "r: description is missing"),
    ('"credential"', '"secret"', "r: unknown family secret|r: keywords gate credential rules alone"),
    ('["key_"]', "[]", "r: a credential rule names a keyword"),
    ('"group": 1', '"group": 2', "r: group 2 of 1"),
    ("{8}", "{8", None),
    ("{8}", "{1001}", "r: regex: a repeat over 1000"),
    ("(key_", "(?=key_)(key_", "r: regex: look-around"),
    ("(key_[a-z]{8})", "(key_)?", "r: regex: it matches the empty string"),
    ('"enabled": true', '"enabled": true, "validators": ["moon-phase"]', "r: unknown validator moon-phase"),
    ('"enabled": true', '"enabled": true, "extent": "whole-line"', "r: unknown extent whole-line"),
    ('"enabled": true', '"enabled": true, "entropy": 2.5', "r: entropy and the validator entropy go together"),
    ('"enabled": true', '"enabled": true, "validators": ["context-label"]', "r: labels and the validator context-label go together"),
    ('"enabled": true', '"enabled": true, "entropy": -1, "validators": ["entropy"]', "r: entropy is negative|r: entropy and the validator entropy go together"),
    ('"enabled": true', '"enabled": true, "entropy": 6, "validators": ["entropy"]', "r: no capture reaches entropy 6: the most is 3.585"),
)


def _document() -> str:
    return json.dumps({"rules": [_GOOD]})


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SAID = "CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN {_quoted(said)}" for i, (_, _, said) in enumerate(_BROKEN) if said) + " WHEN 16 THEN 'more than one JSON value' WHEN 17 THEN 'no rules: nothing would be found' END"


@query(f"""SELECT p_partkey, (i - 1)::BIGINT AS nth, said[i] AS problem FROM (SELECT p_partkey, said, unnest(range(1, len(said) + 1)) AS i FROM (SELECT p_partkey, string_split({_SAID}, '|') AS said FROM part))""")
def rule_problems(spark, sf_dir):
    """A rule document for each part, wrong in the way that its key says: all problems of each, as rows."""
    good, k = F.lit(_document()), F.col("p_partkey") % 18
    text = good
    for i, (old, new, _) in enumerate(_BROKEN):
        text = F.when(k == i, F.replace(good, F.lit(old), F.lit(new))).otherwise(text)
    text = F.when(k == 16, F.concat(good, F.lit(" {}"))).when(k == 17, '{"rules": []}').otherwise(text)
    return rule_documents.problems(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", text.alias("document")), "p_partkey", "document")


@query("SELECT 'r' || (p_partkey % 50) AS rule_id, count(*) AS documents, min(p_partkey) AS first FROM part WHERE p_partkey % 18 NOT IN (16, 17) GROUP BY 1 HAVING count(*) > 1")
def rule_ids_shared(spark, sf_dir):
    """Ids that several documents use, of those that load."""
    k = F.col("p_partkey")
    text = F.replace(F.lit(_document()), F.lit('"id": "r"'), F.concat(F.lit('"id": "r'), (k % 50).cast("string"), F.lit('"')))
    text = F.when((k % 18).isin(16, 17), F.concat(text, F.lit("x"))).otherwise(text)
    return rule_documents.shared_ids(spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", text.alias("document")), "p_partkey", "document")


def _even_digits(v):
    """A check of one's own: the sum of the digits is even."""
    digits = F.split(F.regexp_replace(v, "[^0-9]", ""), "")
    return F.aggregate(digits, F.lit(0), lambda s, d: s + F.coalesce(d.try_cast("int"), F.lit(0))) % 2 == 0


@query(f"""SELECT doc_id, "offset"::BIGINT AS "offset" FROM ({_CARDS}) WHERE list_sum(list_transform(string_split(regexp_replace(value, '[^0-9]', '', 'g'), ''), lambda d: d::INT)) % 2 = 0""")
def own_check(spark, sf_dir):
    """Cards under a check that is registered from outside, by its name."""
    if "even-digits" not in validators.REGISTRY:
        validators.register("even-digits", _even_digits)
    rule = replace(_ANY_CARD, validators=("even-digits",))
    return scan.findings(table(spark, sf_dir, "documents"), "doc_id", "text", [rule]).select("doc_id", "offset")


@query(
    """SELECT 'reading of "' || event_type || '" stopped' AS reason, count(*) FILTER (WHERE event_id % 10 <> 3) AS n, (SELECT count(*) FROM events WHERE event_id % 10 = 3) AS bad_lines
    FROM events GROUP BY event_type HAVING count(*) FILTER (WHERE event_id % 10 <> 3) > 0"""
)
def coverage_log_read(spark, sf_dir):
    """Events as the lines of a log in the shared folder, every tenth of them broken off: what is read, and how many aren't."""
    import uuid

    from palisade.operators import coverage
    from palisade.sources.readers import coverage_log
    from palisade.sources.shared import shared_dir

    events = table(spark, sf_dir, "events")
    reason = F.concat(F.lit('reading of \\"'), F.col("event_type"), F.lit('\\" stopped'))
    line = F.to_json(F.struct(F.col("ts").cast("timestamp").alias("time"), F.lit("PreToolUse").alias("event"), F.lit("v1.0.0").alias("version"), reason.alias("reason"), F.lit(1).alias("other")))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    events.select(F.when(F.col("event_id") % 10 == 3, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    records, bad = coverage_log(spark, [path])
    return coverage.summary(records).select("reason", "n").crossJoin(F.broadcast(bad))  # bad is one row


#: Patterns, and what SQL says of each over whole paths; the fifth is refused.
_GLOBS = (
    ("/home/u*/.aws/*", r"/home/u[^/]*/\.aws/[^./][^/]*"), ("/home/u?/src/*.txt", r"/home/u[^/]/src/[^./][^/]*\.txt"), ("/home/u[0-4]/.*/.env*", r"/home/u[0-4]/\.[^/]*/\.env[^/]*"),
    ("/home/u1[!1]/src/c*", r"/home/u1[^1/]/src/c[^/]*"), ("/home/{u1,u2}/src/x", ""), ("/home/u7/src/.env", r"/home/u7/src/\.env"),
)


@query(
    f"""WITH i AS (SELECT DISTINCT '/home/u' || (p_partkey % 20) || '/' || ({list(_DIRS)})[1 + p_partkey % 4] || '/' || ({list(_NAMES)})[1 + p_partkey % 7] AS path FROM part),
    a AS (SELECT n_nationkey, [{', '.join(map(_quoted, (r for _, r in _GLOBS)))}][1 + n_nationkey % 6] AS regex FROM nation)
    SELECT n_nationkey, path, NULL::VARCHAR AS refused FROM a JOIN i ON regex <> '' AND regexp_full_match(path, regex)
    UNION ALL SELECT n_nationkey, NULL, '{globs.BRACES}' FROM a WHERE regex = ''"""
)
def glob_matches(spark, sf_dir):
    """A pattern of each nation, met with an inventory of paths made of the parts."""
    pick = lambda own, k: F.element_at(F.array(*map(F.lit, own)), (k % len(own) + 1).cast("int"))
    k = F.col("p_partkey")
    path = F.concat(F.lit("/home/u"), (k % 20).cast("string"), F.lit("/"), pick(_DIRS, k), F.lit("/"), pick(_NAMES, k))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", pick([g for g, _ in _GLOBS], F.col("n_nationkey")).alias("pattern"))
    found, refused = globs.expanded(asked, "n_nationkey", "pattern", table(spark, sf_dir, "part").select(path.alias("path")))
    return found.withColumn("refused", F.lit(None).cast("string")).unionByName(refused.withColumn("path", F.lit(None).cast("string")))
