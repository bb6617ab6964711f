"""Cutting long texts into overlapping pieces at natural boundaries, by one bounded regular expression in SQL.

A text is first turned into a string of classes, one letter for each character: ``b`` ends a blank line, ``l`` ends
another line, ``s`` is other white space, ``c`` anything else. On that string the alternatives of one pattern, strongest
boundary first and each bounded by the budget, take a piece after the other:

    .{1,B}\\z | .{0,B-1}b | .{0,B-1}l | .{0,B-1}s | .{1,B}

The last letter of a piece is its boundary, its length a span of the text; running sums give the offsets, and a piece
after the first looks back ``overlap`` characters from its own. Everything stays in the JVM, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = 64  # pieces cut from one part of a long text; a part is itself cut from the text


def boundary_classes(text: Column) -> Column:
    """One class letter for each character (code point) of ``text``."""
    marked = F.regexp_replace(text, r"[^ \t\r\n]", "c")
    marked = F.regexp_replace(marked, r"\r(?=\n)|[ \t]", "s")
    marked = F.regexp_replace(marked, r"[\r\n]", "l")
    return F.regexp_replace(marked, r"(?<![^l])(s*+)l", "$1b")


def cut_pattern(budget: Column) -> Column:
    """The pattern for pieces of at most ``budget`` characters."""
    most, less = budget.cast("string"), (budget - 1).cast("string")
    alternatives = [F.concat(F.lit(".{1,"), most, F.lit(r"}\z"))]
    alternatives += [F.concat(F.lit(".{0,"), less, F.lit("}" + letter)) for letter in "bls"]
    alternatives.append(F.concat(F.lit(".{1,"), most, F.lit("}")))
    return F.concat_ws("|", *alternatives)


def _cuts(df: DataFrame) -> DataFrame:
    """Adds ``_cuts``, the class strings of the pieces of ``_t``."""
    return df.withColumn("_cuts", F.expr("regexp_extract_all(_classes, _pattern, 0)"))


def _prepared(df: DataFrame, key: str, text: str, max_chars: Column, overlap: Column) -> DataFrame:
    rows = df.select(df[key].alias("_k"), df[text].alias("_t"), max_chars.cast("int").alias("_max"), overlap.cast("int").alias("_over"))
    rows = rows.where("_max > 0 and char_length(_t) > _max").withColumn("_over", F.greatest(F.lit(0), F.least(F.coalesce("_over", F.lit(0)), F.col("_max") - 1)))
    return _cuts(rows.withColumn("_classes", boundary_classes(F.col("_t"))).withColumn("_pattern", cut_pattern(F.col("_max") - F.col("_over"))))


def piece_kinds(df: DataFrame, key: str, text: str, max_chars: Column, overlap: Column) -> DataFrame:
    """(``key``, boundary_kind) of each text longer than ``max_chars``: the weakest boundary that the cutting needed.

    A cut takes the strongest boundary within the budget, so a weaker one is needed exactly where a stretch without
    stronger boundaries is longer than the budget. Null and shorter texts give no row; repeated rows repeat.
    """
    last = F.transform(F.slice("_cuts", 1, F.size("_cuts") - 1), lambda p: F.right(p, F.lit(1)))
    # What is left at the end is a piece whole, however it ends.
    kind = (
        F.when(F.array_contains("_last", "c"), "none").when(F.array_contains("_last", "s"), "space").when(F.array_contains("_last", "l"), "line").otherwise("blank_line")
    )
    rows = _prepared(df, key, text, max_chars, overlap).select("_k", last.alias("_last"))
    return rows.select(F.col("_k").alias(key), kind.alias("boundary_kind"))


def split_texts(df: DataFrame, key: str, text: str, max_chars: Column, overlap: Column) -> DataFrame:
    """(``key``, piece_no, char_start, n_chars, boundary_kind, piece): ordered pieces of at most ``max_chars`` characters.

    A piece after the first starts with the ``overlap`` characters before its own text; ``char_start`` is where the
    piece, overlap included, starts in the text, from 0. boundary_kind tells what ends the piece, ``end`` for the last.
    Texts not longer than ``max_chars`` (a null or non-positive limit gives none) and null texts give no rows; an
    overlap of null is 0, one of ``max_chars`` or more is ``max_chars - 1``; repeated rows repeat their pieces.
    """
    rows = _prepared(df, key, text, max_chars, overlap)
    rows = rows.withColumn("_sizes", F.transform("_cuts", lambda p: F.length(p)))
    rows = rows.withColumn("_kinds", F.transform("_cuts", lambda p: F.right(p, F.lit(1)))).drop("_classes", "_cuts", "_pattern")
    # Offsets by sums over parts of GROUP pieces and over GROUP such parts: no array is copied piece by piece.
    total = f"transform(sequence(0, (size({{0}}) - 1) div {GROUP}), g -> aggregate(slice({{0}}, g * {GROUP} + 1, {GROUP}), 0, (s, x) -> s + x))"
    rows = rows.withColumn("_sums", F.expr(total.format("_sizes")))
    rows = rows.withColumn("_tops", F.expr(total.format("_sums")))
    before = "aggregate(slice({0}, {1} + 1, {2}), 0, (s, x) -> s + x)"
    starts = f"{before.format('_tops', '0', f'g div {GROUP}')} + {before.format('_sums', f'(g div {GROUP}) * {GROUP}', f'g % {GROUP}')}"
    rows = rows.withColumn("_starts", F.expr(f"transform(sequence(0, size(_sums) - 1), g -> {starts})"))
    # Parts first: cutting each piece from the whole of a very long text would be quadratic.
    parts = rows.select(
        "_k",
        "_over",
        F.size("_sizes").alias("_n"),
        F.expr(
            f"""posexplode(transform(_starts, (at, g) -> named_struct(
                'at', at,
                'from', greatest(0, at - _over),
                'sizes', slice(_sizes, g * {GROUP} + 1, {GROUP}),
                'kinds', slice(_kinds, g * {GROUP} + 1, {GROUP}),
                'text', substring(_t, greatest(0, at - _over) + 1, at + _sums[g] - greatest(0, at - _over)))))"""
        ).alias("_g", "_part"),
    )
    pieces = parts.select("_k", "_over", "_n", "_g", F.col("_part.at").alias("_at"), F.col("_part.from").alias("_from"), F.col("_part.text").alias("_text"), F.col("_part.kinds").alias("_kinds"), F.col("_part.sizes").alias("_sizes"), F.posexplode("_part.sizes").alias("_i", "_size"))
    own = F.col("_at") + F.expr(before.format("_sizes", "0", "_i"))
    start = F.greatest(F.lit(0), own - F.col("_over"))
    size = own + F.col("_size") - start
    number = F.col("_g") * GROUP + F.col("_i")
    kind = F.expr(f"case when _g * {GROUP} + _i + 1 = _n then 'end' else element_at(map('b', 'blank_line', 'l', 'line', 's', 'space', 'c', 'none'), _kinds[_i]) end")
    return pieces.select(
        F.col("_k").alias(key),
        number.cast("int").alias("piece_no"),
        start.cast("int").alias("char_start"),
        size.cast("int").alias("n_chars"),
        kind.alias("boundary_kind"),
        F.substring(F.col("_text"), start - F.col("_from") + 1, size).alias("piece"),
    )


def extension(path: Column) -> Column:
    """Text after the last dot of the last path component, lower-cased; null if there is no dot."""
    return F.when(F.regexp_extract(path, r"([^/]*)$", 1).contains("."), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))


def with_limits(files: DataFrame, limits: DataFrame, key: str = "file_id", text: str = "content", path: str = "path") -> DataFrame:
    """(``key``, ``text``, _max, _overlap) with the limits of the file's extension, else of ``*``, else null.

    ``limits`` is a settings table of one row for each extension; Spark broadcasts it below its own threshold. Other
    columns of ``files`` are dropped, so their names don't matter; a null path has no extension.
    """
    limits = limits.where("extension is not null").groupBy(F.lower("extension").alias("_ext")).agg(F.max(F.struct("max_chars", "overlap_chars")).alias("_lim"))
    rest = limits.where("_ext = '*'").select("_lim.max_chars", "_lim.overlap_chars").first()  # one row
    most, over = rest or (None, None)
    rows = files.select(files[key].alias("_key"), files[text].alias("_text"), extension(files[path]).alias("_e"))
    joined = rows.join(limits.where("_ext <> '*'"), F.col("_e") == F.col("_ext"), "left")
    return joined.select(
        F.col("_key").alias(key),
        F.col("_text").alias(text),
        F.coalesce("_lim.max_chars", F.lit(most).cast("int")).alias("_max"),
        F.when(F.col("_lim").isNotNull(), F.col("_lim.overlap_chars")).otherwise(F.lit(over).cast("int")).alias("_overlap"),
    )
