"""Fill-in-the-middle transformation by escaped marker injection; DataFrame functions only.

A text is cut into units (the spaces before a word and the word, or spaces at the end). A delimiter is escaped in the text, then
appended to every unit by one ``regexp_replace``; counting it gives the number of units, ``substring_index`` the parts before,
between and after two of them, which are unescaped and put together behind the markers. Where to cut, and into what form, follows
from a hash of the seed and the row's id, so every run gives the same output, whatever the partitions. Nothing is shuffled.

A text that is empty or holds a marker stays plain, so that each output can be read back: ``restored`` gives the exact text from
output and form alone. In the other forms each marker stands in the output once: no marker begins or ends with a part of another.

Defined cases: a null text is empty, and so plain; a null id hashes as the empty string. A text is worked on whole, however long, as one value
of one row (some 8 times its bytes of memory). Equal rows give equal outputs. Columns of the input named as those that are added are
replaced, others kept. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Percent of the texts that are cut, and of those the percent whose suffix comes first of all.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Neither is a space, nor are the letters of the escapes: units of the escaped text are those of the text.
_ESCAPE, _DELIMITER = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """``text`` without a delimiter."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_DELIMITER), F.lit(_ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """The text behind ``escaped`` and any number of delimiters put in."""
    bare = F.replace(text, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "d"), F.lit(_DELIMITER)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def draws(seed: int, key: Column) -> list[Column]:
    """Four 32-bit numbers from a hash of the seed and the row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    after = F.substring_index(output, SUFFIX, -1)
    psm = F.concat(F.substring_index(F.substring(output, len(PREFIX) + 1, 2**31 - 1), SUFFIX, 1), F.substring_index(output, MIDDLE, -1), F.substring_index(after, MIDDLE, 1))
    spm = F.concat(F.substring_index(F.substring_index(output, PREFIX, -1), MIDDLE, 1), F.substring_index(output, MIDDLE, -1), F.substring_index(after, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


class FillInMiddle:
    """``transform(docs)``: texts with a part moved behind what follows it; see the module."""

    def __init__(self, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> None:
        """``rate``: percent of texts to cut; ``spm_rate``: percent of those with the suffix first."""
        self.seed, self.rate, self.spm_rate = seed, rate, spm_rate

    def transform(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The columns of ``docs`` and: n (units), form (plain, psm, spm), output, and, null where plain, prefix_chars and middle_chars."""
        added = ("n", "form", "output", "prefix_chars", "middle_chars")
        names = [c for c in docs.columns if c.lower() not in added]
        text = F.coalesce(F.col("doc")[text_col].cast("string"), F.lit(""))
        rows = docs.select(F.struct("*").alias("doc"))
        rows = rows.select("doc", text.alias("text"), *(h.alias(f"h{k}") for k, h in enumerate(draws(self.seed, F.col("doc")[id_col]), 1)))
        # "\$0" is the match: what stands before a delimiter is a unit.
        rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + _DELIMITER))
        rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(_DELIMITER), F.lit("")))).cast("long"))
        cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
        rows = rows.withColumn("low", F.least(*cuts).cast("int")).withColumn("high", F.greatest(*cuts).cast("int"))
        holds = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
        plain = (F.col("text") == "") | holds | (F.col("h3") % 100 >= self.rate)
        rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < self.spm_rate, "spm").otherwise("psm"))

        def index(column: str, count: Column) -> Column:
            return F.call_function("substring_index", F.col(column), F.lit(_DELIMITER), count)

        cut = F.col("form") != "plain"
        rows = rows.withColumn("head", F.when(cut, index("marked", F.col("high"))))
        parts = rows.select(
            "doc",
            "n",
            "form",
            "text",
            F.when(cut, unescaped(index("head", F.col("low")))).alias("prefix"),
            F.when(cut, unescaped(index("head", F.col("low") - F.col("high")))).alias("middle"),
            F.when(cut, unescaped(index("marked", (F.col("high") - F.col("n") - 1).cast("int")))).alias("suffix"),
        )
        psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
        spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
        output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
        return parts.select(*(F.col("doc")[c].alias(c) for c in names), "n", "form", output.alias("output"), F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"))
