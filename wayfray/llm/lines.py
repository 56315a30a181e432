"""Line dedup by a log-template tree (operator 4), DataFrame functions only.

A line's words pass a fixed-depth tree: word count, then the leading words, with variable
fields (words with a digit, addresses) generalised. In each leaf, forms that agree in three
of four quarters of their words share a template, the quarter that differs being variable;
a leaf has any number of templates. Lines of fewer than ``least`` words are too short for
that and are templates only as they stand, so that short prose with a common beginning
stays. A template found in ``min_docs`` documents or more recurs: its lines are
dropped from every document but the first one (smallest doc_id) that has it, so that no
content is lost altogether.

Defined cases: a null text stays null, an empty one empty; lines without words stay where
they are unless every line with words was dropped, when the text becomes empty; a document
given twice counts once and both rows are cut alike; a null doc_id counts as one document
that is never the first; an empty table gives an empty result; other columns are kept
untouched, but n_lines and n_dropped are replaced unless ``counts`` is false. Rows that travel are hashes of fixed size; a text moves once, to its marks.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, frozen

#: A word that generalises to a field.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*"
#: What stands for it.
MARK = "<*>"


def generalised(line: Column) -> Column:
    """The line's words, variable fields marked."""
    return F.regexp_extract_all(F.regexp_replace(line, FIELD, MARK), F.lit(f"({WORD})"), 1)


#: Parts that a leaf's or a form's lines are joined in, as one may hold most lines.
SALTS = 16


def _salted(rows: DataFrame) -> DataFrame:
    """Each row once for every part."""
    return rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _part() -> Column:
    return F.pmod(F.xxhash64("id", "pos"), F.lit(SALTS)).cast("int")


def line_rows(docs: DataFrame, depth: int = 3, least: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per line with words: id, th (hash of the text), pos, leaf, form and q0..q3 (hashes of all words and of the quarters; of short lines null)."""
    lines = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    words = lines.select("id", "th", "pos", generalised(F.col("line")).alias("w"), F.size(generalised(F.col("line"))).alias("n")).where(F.size("w") > 0)
    step = F.expr("cast(ceil(n / 4) as int)")
    quarters = [F.when(F.col("n") >= least, F.xxhash64(F.slice("w", F.lit(1) + k * step, step))).alias(f"q{k}") for k in range(4)]
    return words.select("id", "th", "pos", F.xxhash64("n", F.slice("w", 1, depth)).alias("leaf"), F.xxhash64("w").alias("form"), *quarters)


def recurring(lines: DataFrame, agree: int = 3, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """The lines that may recur (id, th, pos, leaf, form), and the forms of recurring templates (leaf, form, first).

    A template is ``agree`` quarters of a leaf; a form belongs to all that its quarters make, and goes by the one whose
    first document is the least. The smallest ``min_docs`` documents of a form are enough to tell whether its templates
    have as many, and which is first."""
    several = (F.col("_n") >= min_docs) & (F.col("_low") < F.col("_high"))
    wide = lines.groupBy("leaf").agg(F.count("*").alias("_n"), F.min("id").alias("_low"), F.max("id").alias("_high"))
    some = frozen(lines.withColumn("_s", _part()).join(_salted(wide.where(several).select("leaf")), ["leaf", "_s"], "left_semi").drop("_s"))
    qs = [f"q{k}" for k in range(4)]
    place = F.row_number().over(Window.partitionBy("leaf", "form").orderBy(F.col("id").asc_nulls_last()))  # each map task passes on no more than min_docs
    few = frozen(some.select("leaf", "form", *qs, "id").distinct().withColumn("_k", place).where(F.col("_k") <= min_docs))
    wild = F.array(*[F.xxhash64("leaf", F.lit(k), *c) for k, c in enumerate(itertools.combinations(qs, agree))])
    template = F.explode(F.when(F.col("q0").isNull(), F.array(F.xxhash64("leaf", F.lit(-1), "form"))).otherwise(wild)).alias("template")
    found = few.select(template, "id").distinct().groupBy("template").agg(F.count("*").alias("docs"), F.min("id").alias("first")).where(F.col("docs") >= min_docs)
    forms = few.where(F.col("_k") == 1).select("leaf", "form", template).join(found.select("template", "first"), "template")
    return some.select("id", "th", "pos", "leaf", "form"), forms.groupBy("leaf", "form").agg(F.min("first").alias("first"))


def drop_recurring_lines(docs: DataFrame, depth: int = 3, agree: int = 3, min_docs: int = 3, least: int = 8, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """docs with the lines of recurring templates dropped from ``text_col``, and with ``counts`` n_lines, n_dropped (long)."""
    mine, found = recurring(frozen(line_rows(docs, depth, least, id_col, text_col)), agree, min_docs)
    gone = mine.withColumn("_s", _part()).join(_salted(found), ["leaf", "form", "_s"]).where(~F.col("id").eqNullSafe(F.col("first")))
    marks = gone.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("_gone"))
    named = marks.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "_gone")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    own = F.col("_row")[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(F.col("_row")[text_col]) == F.col("_th"))
    text, n_lines, n_dropped = cut(F.col("_row")[text_col])
    kept = [(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    return rows.join(named.hint("shuffle_hash"), own, "left").select(*kept, *([n_lines.alias("n_lines"), n_dropped.alias("n_dropped")] if counts else []))


def cut(text: Column) -> tuple[Column, Column, Column]:
    """A text without the lines at the sorted positions in _gone, its lines with words, and how many are gone.

    Linear in the lines: what lies between two positions is a slice, and the split text is
    bound once, as the only element of an array."""
    gone = F.coalesce("_gone", F.array().cast("array<int>"))

    def between(parts: Column) -> Column:
        def piece(j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(gone, j - 1) + 1)
            return F.slice(parts, start + 1, F.coalesce(F.get(gone, j), F.size(parts)) - start)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), piece))

    kept = F.element_at(F.transform(F.array(F.split(text, "\n")), between), 1)
    left = F.array_join(kept, "\n")
    n_lines = F.coalesce(F.regexp_count(F.concat(F.lit("\n"), text), F.lit(r"\n[^\n]*?[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    new = F.when(F.size(gone) == 0, text).otherwise(F.when(F.regexp_like(left, F.lit(WORD)), left).otherwise(F.lit("")))
    return new, n_lines, F.size(gone).cast("long")
