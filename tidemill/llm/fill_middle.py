r"""Fill-in-middle examples by escaped marker injection, with DataFrame functions only.

A text becomes a sequence of units (code points) that a delimiter ends:

1. the delimiter and the escape character are escaped where the text has them, so that a
   delimiter can only be one that is put in next;
2. regexp_replace appends the delimiter to each unit (an escaped pair is one unit);
3. the delimiters are counted: n, the number of units;
4. substring_index takes the first a units, the b - a after them, and the rest;
5. each part loses its delimiters and escapes, and the parts are put behind their markers.

a and b are the smaller and the larger of two hashes modulo n + 1; further hashes say whether
the text is transformed and in which order. All of them come from the sha256 of seed and
doc_id, so a rerun on any cluster gives the same examples. Every row is worked on by itself:
no shuffle, and a hot document costs what its length costs.

Null texts count as empty, and an empty text stays plain, as does one that contains a marker
(its example could not be taken apart again). A null doc_id counts as ''. Repeated rows give
repeated rows, an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = "1:"
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
FIM_PERCENT, SPM_PERCENT = 90, 20
#: The delimiter that ends a unit, the character that escapes, and what stands behind it for either.
DELIMITER, ESCAPE = "\x1f", "\x10"
FOR_ESCAPE, FOR_DELIMITER = ESCAPE + "0", ESCAPE + "1"
UNIT = f"(?s){ESCAPE}.|."


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(FOR_ESCAPE)), F.lit(DELIMITER), F.lit(FOR_DELIMITER))


def unescaped(part: Column) -> Column:
    """Of some units with their delimiters: the text."""
    plain = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(plain, F.lit(FOR_DELIMITER), F.lit(DELIMITER)), F.lit(FOR_ESCAPE), F.lit(ESCAPE))


def marked(text: Column) -> Column:
    """The text with a delimiter behind each unit."""
    return F.regexp_replace(escaped(text), UNIT, f"$0{DELIMITER}")


def units(m: Column) -> Column:
    """How many units a marked text has: its delimiters."""
    return (F.octet_length(m) - F.octet_length(F.replace(m, F.lit(DELIMITER), F.lit("")))).cast("long")


def _index(m: Column, n: Column) -> Column:
    return F.call_function("substring_index", m, F.lit(DELIMITER), n.cast("int"))


def first_units(m: Column, k: Column) -> Column:
    return _index(m, k)


def last_units(m: Column, k: Column) -> Column:
    """The last k units of a marked text, behind whose last delimiter one more, empty, part stands."""
    return _index(m, -(k + 1))


def hashes(doc_id: Column, seed: str, n: int) -> list[Column]:
    """n whole numbers below 2**32 from one digest."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(n)]


def joined(form: Column, prefix: Column, middle: Column, suffix: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The example of a form: psm (prefix, suffix, middle) or spm (suffix, prefix, middle)."""
    p, s, m = map(F.lit, markers)
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text that an example was made of. Its parts hold no marker, so each marker stands in it once."""
    p, s, m = markers

    def part(begin: str, end: str | None) -> Column:
        rest = F.call_function("substring_index", output, F.lit(begin), F.lit(-1))
        return rest if end is None else F.call_function("substring_index", rest, F.lit(end), F.lit(1))

    psm = F.concat(part(p, s), part(m, None), part(s, m))
    spm = F.concat(part(p, m), part(m, None), part(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, markers: Sequence[str] = MARKERS) -> DataFrame:
    """Per row: doc_id, n (code points), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    fim_percent: how many of 100 texts are transformed; spm_percent: how many of these give the suffix first."""
    if len(set(markers)) != 3 or not all(markers) or any(a != b and a in b for a in markers for b in markers):
        raise ValueError("three markers are needed, none within another")
    text, (h1, h2, h3, h4) = F.coalesce(F.col("text"), F.lit("")), hashes(F.col("doc_id"), seed, 4)
    plain = (F.col("text") == "") | (h3 % 100 >= fim_percent)
    for marker in markers:
        plain = plain | F.contains(F.col("text"), F.lit(marker))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    cut = docs.select("doc_id", text.alias("text")).select("doc_id", "text", marked(F.col("text")).alias("marked"), form.alias("form"))
    cut = cut.select("*", units(F.col("marked")).alias("n"))
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    cut = cut.select("*", F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    m, a, b, n = map(F.col, ("marked", "a", "b", "n"))
    prefix, middle, suffix = first_units(m, a), last_units(F.concat(first_units(m, b), F.lit(DELIMITER)), b - a), last_units(m, n - b)
    example = joined(F.col("form"), *map(unescaped, (prefix, middle, suffix)), markers)
    chars = lambda c: F.when(F.col("form") != "plain", c)
    return cut.select("doc_id", "n", "form", chars(a).alias("prefix_chars"), chars(b - a).alias("middle_chars"), F.coalesce(example, F.col("text")).alias("output"))


def digest(examples: DataFrame, markers: Sequence[str] = MARKERS) -> DataFrame:
    """The examples with sha256 of output and of the text rebuilt from it instead of the texts."""
    back = restored(F.col("output"), F.col("form"), markers)
    return examples.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(back, "UTF-8"), 256).alias("restored_sha256")
    )


FILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y, CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(x, y) AS a, greatest(x, y) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
        WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
        ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END AS output FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
