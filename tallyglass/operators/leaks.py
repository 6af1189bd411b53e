"""Whether documents that should hold digests only hold raw values of a source.

Documents are cut into overlapping pieces whose n-grams are the index. A value can only
be in a piece if all its n-grams are in the index, so most values end there; those left
are looked up by their rarest n-gram alone and then compared whole with the pieces
that hold it. Values are looked for as they are, where neither side goes on with a letter
or digit, and as the hexadecimal digits of their UTF-8 bytes.

Scale: exchanges of the distinct n-grams of each piece, of the distinct values and of the
values' n-grams; none of the source's rows beyond the first aggregation. A value whose
rarest n-gram is frequent meets every piece that has it: pieces are joined by n-gram
and salt, and only their numbers travel with the n-grams, not their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import dropped, stored

#: Letters of an n-gram, the shortest value that is looked for, and letters of a piece at least: n-grams are cut in time quadratic in a piece.
GRAM, LEAST, PIECE = 6, 8, 1 << 10
#: Parts that the pieces of one n-gram are dealt to.
SALTS = 16


def _grams(text: str) -> str:
    return f"array_distinct(transform(sequence(1, length({text}) - {GRAM - 1}), i -> xxhash64(substring({text}, i, {GRAM}))))"


def leaked_values(documents: DataFrame, source: DataFrame, fields: list[str], id_col: str = "path", text_col: str = "document", least: int = LEAST) -> DataFrame:
    """(document, field, value, form) of each value of the source's fields, as text of `least` letters or more, that a document holds; form is plain or hex.

    Shorter values aren't looked for, as digests hold any of them by chance. Values count
    once, however many rows have them; nulls aren't values and null or empty documents hold
    none. Other columns, whatever their names, aren't read. Empty tables give no rows.
    """
    if least < GRAM:
        raise ValueError(f"values have {GRAM} letters at least")
    one = [source.select(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]
    if not one:
        raise ValueError("no fields")
    values = one[0]
    for x in one[1:]:
        values = values.unionByName(x)
    values = values.where(F.length("value") >= least).distinct()
    forms = F.explode(F.array(F.struct(F.lit("plain").alias("form"), F.col("value").alias("seek")), F.struct(F.lit("hex").alias("form"), F.lower(F.hex(F.encode("value", "UTF-8"))).alias("seek"))))
    values = stored(values.select("field", "value", forms.alias("f")).select("field", "value", "f.*").withColumn("id", F.xxhash64("field", "value", "form")), "values")
    longest = values.agg(F.max(F.length("seek"))).first()[0] or 0
    step = max(PIECE, 2 * longest)
    text = F.concat(F.lit(" "), F.col(text_col).cast("string"), F.lit(" "))
    # a piece holds every value that starts before the next one, with its neighbours
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int")))
    pieces = documents.select(F.col(id_col).alias("document"), text.alias("text")).where(F.length("text") >= GRAM).select("document", "text", cut.alias("part"))
    pieces = pieces.select("document", "part", F.substring("text", F.col("part") * step + 1, F.lit(step + longest + 2)).alias("text"))
    pieces = stored(pieces.withColumn("piece", F.xxhash64("document", "part", "text")), "pieces")
    index = stored(pieces.select("piece", F.explode(F.expr(_grams("text"))).alias("gram")), "grams")
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    wanted = values.select("id", F.explode(F.expr(_grams("seek"))).alias("gram"))
    met = wanted.join(counts, "gram", "left").groupBy("id").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram")).where("n > 0")
    salted = met.select("id", "gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = salted.join(index.withColumn("salt", F.pmod("piece", F.lit(SALTS)).cast("int")), ["gram", "salt"]).select("id", "piece").distinct()
    both = pairs.join(values, "id").join(pieces, "piece")
    found = both.where(F.contains("text", "seek"))
    quoted = F.concat(F.lit(r"[^\p{L}\p{N}]\Q"), F.replace("seek", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E[^\p{L}\p{N}]"))
    found = found.where((F.col("form") == "hex") | F.regexp_like("text", quoted))
    out = stored(found.select("document", "field", "value", "form").distinct(), "leaks")
    dropped(index, pieces, values)
    return out
