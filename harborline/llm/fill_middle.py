"""Fill-in-the-middle transformation by counted possessive quantifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.common import subset, text_or_empty

#: What opens prefix, suffix and middle, and a unit with its white space in front, as a regular expression.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
SEED = 42
#: Percent of the texts that are cut at all, and of those, percent with the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 50, 80


def _draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
    cut_percent: int = CUT_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
) -> DataFrame:
    """Key, n, form, output, prefix_chars and middle_chars of each whole text.

    A text is n units, each a run of other characters with the white space in front, a white tail one of its own.
    regexp_count gives n; two draws from the key's hash are the units that the prefix and the middle end after; and one match
    of a pattern made for the row takes all three parts, as its quantifiers are possessive: they count up to their
    number without a record to go back to, so neither a long text nor a long part uses stack or takes
    more than one pass. form is plain (the text as it is), psm (prefix, suffix, middle) or spm (suffix, prefix, middle).
    Plain are empty texts, those that hold one of the marks, and those that a third draw leaves out.

    Nulls count as empty texts; a null key is drawn as an empty one. Repeated rows come out as often as they came in;
    an empty table gives none; other columns play no part. One narrow pass in the JVM.
    """
    rows = subset(docs, key, text).select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    h1, h2, h3, h4 = _draws(F.col("key"), seed)
    n = F.regexp_count("text", F.lit(UNIT)).cast("long")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= cut_percent)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first_percent, "spm").otherwise("psm")
    drawn = rows.select("key", "text", n.alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    drawn = drawn.select("key", "text", "n", "form", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    counted = [F.lit(rf"(?s)\A((?:{UNIT}){{"), F.col("a"), F.lit(rf"}}+)((?:{UNIT}){{"), F.col("b") - F.col("a"), F.lit(r"}+)(.*+)\z")]
    pattern = F.concat(*(c.cast("string") for c in counted))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    made = drawn.select("key", "n", "form", output.alias("output"))
    # No mark stands in a text that was cut, and no mark ends as another begins, so the first place of each is its own.
    places = [F.instr("output", mark).alias(name) for mark, name in ((PREFIX, "p"), (SUFFIX, "s"), (MIDDLE, "m"))]
    made = made.select("key", "n", "form", "output", *places, F.length("output").alias("size"))
    after = F.when(F.col("form") == "psm", F.col("s")).when(F.col("form") == "spm", F.col("m"))
    return made.select(
        F.col("key").alias(key), "n", "form", "output",
        (after - F.col("p") - len(PREFIX)).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("size") - F.col("m") - len(MIDDLE) + 1).cast("long").alias("middle_chars"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of."""
    first = rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z"
    last = rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z"
    is_first = F.col(form) == "psm"
    text = F.regexp_replace(output, F.when(is_first, first).otherwise(last), F.when(is_first, "$1$3$2").otherwise("$2$3$1"))
    return F.when(F.col(form) == "plain", F.col(output)).otherwise(text)
