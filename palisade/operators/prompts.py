"""Files that prompts name with an at sign."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.paths import resolved
from palisade.operators.scan import withheld

# Fixed value: white space by Unicode, and the byte order mark, which part tokens.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: What may follow a name: ASCII punctuation, but for the slash.
TRAILING = string.punctuation.replace("/", "")


def at_tokens(prompt: Column) -> Column:
    """Tokens that an @ starts at the beginning or after white space, up to the next white space."""
    return F.regexp_extract_all(prompt, F.lit(f"(?<![^{SPACE}])@([^{SPACE}]+)"), F.lit(1))


def token_candidates(token: Column) -> Column:
    """The token, and each form with one more trailing punctuation mark taken off; none is empty."""
    tail = F.length(token) - F.length(F.regexp_replace(token, "[" + "".join("\\" + c for c in TRAILING) + "]+$", ""))
    forms = F.transform(F.sequence(F.lit(0), tail), lambda k: F.substring(token, F.lit(1), F.length(token) - k))
    return F.filter(forms, lambda x: x != "")


def named_files(prompts: DataFrame, key: str, prompt: str, inventory: DataFrame, cwd: str, home: str = "/home") -> DataFrame:
    """key, path, kind, content of the files and directories that prompts name, each once. inventory: path, kind
    (file or dir) and content; names of nothing that is there are passed over. A directory's content is the
    sorted names in it, one a line."""
    token = prompts.select(key, cwd, F.explode(at_tokens(F.col(prompt))).alias("token"))
    form = token.select(key, cwd, F.explode(token_candidates(F.col("token"))).alias("form")).where(~F.col("form").rlike(r"^[./]+$"))
    path = form.select(key, resolved(F.col("form"), F.col(cwd), F.lit(home)).alias("path")).where("path IS NOT NULL").dropDuplicates([key, "path"])
    listed = inventory.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("dir"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    listed = listed.groupBy("dir").agg(F.array_join(F.sort_array(F.collect_list("name")), "\n").alias("names"))
    found = path.join(inventory, "path").join(listed, F.col("path") == F.col("dir"), "left")
    content = F.when(F.col("kind") == "dir", F.encode(F.coalesce("names", F.lit("")), "UTF-8")).otherwise(F.col("content").cast("binary"))
    return found.select(key, "path", "kind", content.alias("content"))


def sent_by(prompts: DataFrame, key: str, prompt: str, inventory: DataFrame, cwd: str, home: str = "/home") -> DataFrame:
    """key, label, content: all that a prompt sends, its own text and the files that it names. Labels that hold a
    finding are withheld."""
    own = prompts.where(F.col(prompt).isNotNull()).select(key, F.lit("<prompt>").alias("label"), F.encode(prompt, "UTF-8").alias("content"))
    named = named_files(prompts, key, prompt, inventory, cwd, home).select(key, withheld(F.col("path")).alias("label"), "content")
    return own.unionByName(named)
