"""Fill-in-middle documents by escaped marker injection: DataFrame functions only, no shuffle, one pass over the texts.

A delimiter that no escaped text holds is appended to every unit (a word with the white space before it, or white space
that ends a text), so counting delimiters counts units and substring_index takes any ranked part. Delimiter and escape
sign are no white space and are escaped as such, so escaping moves no unit's bounds. Two cuts, the order of the parts
and whether a document is changed at all come from a hash of doc_id, so a document has the same form in every run.

Nulls: a null text is empty; a null doc_id hashes as the empty string. An empty text, or one that holds a control string,
stays plain. Rows that share a doc_id have the same hash, and repeated rows the same result. An empty table gives no
rows. Columns other than the key and the text are left out, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galley.llm.common import text_or_empty

# The control strings, and the units of a text.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Percent of documents that are changed, and percent of those that are laid out suffix first.
RATE, SPM_RATE, SEED = 50, 80, 42
DELIMITER, ESCAPE = "\x1e", "\x1b"


def escaped(text: Column) -> Column:
    """Text without delimiters: the escape sign is doubled by a letter of its own, the delimiter becomes another pair."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}e")), F.lit(DELIMITER), F.lit(f"{ESCAPE}d"))


def unescaped(part: Column) -> Column:
    """The text of ranked parts: delimiters go, pairs become what they stand for."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{ESCAPE}d"), F.lit(DELIMITER)), F.lit(f"{ESCAPE}e"), F.lit(ESCAPE))


def _words_of_hash(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit numbers of the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, text, n (units), form, prefix, middle, suffix (null if plain) and output of every row."""
    tidy = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    h1, h2, h3, h4 = _words_of_hash(F.col("doc_id"), seed)
    marked = tidy.select("*", F.regexp_replace(escaped(F.col("text")), UNIT, f"$0{DELIMITER}").alias("marked"))
    counted = marked.select("*", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("long").alias("n"))
    clash = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | clash | (F.pmod(h3, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm_rate, "spm").otherwise("psm")
    cut1, cut2 = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = counted.select("*", form.alias("form"), F.least(cut1, cut2).cast("int").alias("lo"), F.greatest(cut1, cut2).cast("int").alias("hi"))
    ranked = lambda text, count: F.call_function("substring_index", text, F.lit(DELIMITER), count)
    n, lo, hi, changed = F.col("n").cast("int"), F.col("lo"), F.col("hi"), F.col("form") != "plain"
    parts = {
        "prefix": ranked(F.col("marked"), lo),
        "middle": ranked(ranked(F.col("marked"), hi), lo - hi),
        "suffix": ranked(F.col("marked"), hi - n - 1),  # the last delimiter ends the text, so one part more
    }
    cut = cut.select("doc_id", "text", "n", "form", *(F.when(changed, unescaped(p)).alias(k) for k, p in parts.items()))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    return cut.select("*", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made. No part holds a control string and none can arise where two parts meet."""
    after = lambda mark: F.substring_index(output, mark, -1)
    until = lambda mark, stop: F.substring_index(after(mark), stop, 1)
    psm = F.concat(until(PREFIX, SUFFIX), after(MIDDLE), until(SUFFIX, MIDDLE))
    spm = F.concat(until(PREFIX, MIDDLE), after(MIDDLE), until(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_hex = lambda k: f"CAST('0x' || substr(d, {1 + 8 * k}, 8) AS BIGINT)"
OP13_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
u AS (SELECT *, regexp_extract_all(text, '{UNIT}') AS us FROM t),
c AS (SELECT *, CAST(len(us) AS BIGINT) AS n, {_hex(0)} % (len(us) + 1) AS a, {_hex(1)} % (len(us) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR {_hex(2)} % 100 >= {RATE} THEN 'plain'
       WHEN {_hex(3)} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(us[1:least(a, b)], '') AS pre, array_to_string(us[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(us[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
