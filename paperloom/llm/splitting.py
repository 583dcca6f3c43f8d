"""Splitting oversized items at natural boundaries (problem 3).

The text of an item is laid out as one character per UTF-8 byte, so the bounded quantifiers of a
regular expression count bytes.  One expression then consumes the item piece by piece: its
alternatives are ordered by boundary strength (block, line, sentence, word) and each takes as much as
the limit allows; the last one takes characters.  Lookback offsets over the array of cores add the
overlap.  Everything is array functions over one row, so nothing is shuffled and a long item costs
time in proportion to its length.

A block is a maximal run of non-blank lines; blank lines in fenced code do not end it.  Before the
pieces are cut the line break that ends a block is marked, so code is not taken for a boundary.

Defined results: an item within the limit is one piece, itself; null or blank items give no piece;
cores put together give the item back byte for byte; a piece starts with the last ``overlap`` bytes
of the core before it (up to three more, so as not to cut a character); no piece exceeds the limit, which must be more
than twice the overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import boxed, unboxed

#: One segment is a block with the blank lines after it, or a single blank line or character between blocks.
_FENCE = "(?:" + "|".join(rf"{m}[^\n]*+(?:\n(?!{m})[^\n]*+)*+(?:\n{m}[^\n]*+)?+" for m in ("```", "~~~")) + ")"
_LINE = r"(?:(?!```|~~~)[^\S\n]*+[^\s][^\n]*+)"
_BLOCK = rf"(?:{_FENCE}|{_LINE})(?:\n(?:{_FENCE}|{_LINE}))*+"
SEGMENT = rf"(?U){_BLOCK}(?:\n(?:[^\S\n]*+\n)*+)?+|[^\S\n]*+\n|[^\S\n]++|[\s\S]"
_AFTER_BLOCK = r"(?U)\n(?:[^\S\n]*+\n)*+[^\S\n]*+\z"
#: Stands for the line break before a new block while pieces are cut; outside the byte range.
_MARK = "Ā"


def core_pattern(most: int, least: int) -> str:
    """Alternatives by boundary strength, each of ``least`` to ``most`` bytes, a quarter full at first.

    The end of the item is ``\\z``: in this layout byte 0x85 counts as a line end, before which ``$`` would match.
    """
    some = max(least, most // 4)
    ends = [
        rf"(?<={_MARK})",
        rf"(?<=[\n{_MARK}])",
        r"(?:(?<=[.!?][ \t])|(?<=\xE2\x80\xA6[ \t])|(?<=\xE3\x80\x82)|(?<=\xEF\xBC[\x81\x9F]))",
        r"(?<=[ \t])",
    ]
    tries = [rf"[\s\S]{{{some},{most}}}{end}" for end in ends[:3]] + [rf"[\s\S]{{{least},{most}}}{end}" for end in ends]
    return "(?:" + "|".join([rf"[\s\S]{{1,{most}}}\z", *tries, rf"[\s\S]{{1,{most}}}(?![\x80-\xBF])", r"[\s\S]"]) + ")"


def _bytes(c: F.Column) -> F.Column:
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _text(c: F.Column) -> F.Column:
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def split_items(items: DataFrame, text: str, limit: int, overlap: int) -> DataFrame:
    """Adds to each item: blocks (sizes in bytes, in order), pieces (array of texts) and shared (bytes of
    each piece that the piece before it holds as well).

    ``blocks`` is null for items within the limit, whose only piece is the item itself.
    """
    source = F.col("_text")
    over = F.octet_length(source) > limit
    segments = F.when(over, F.regexp_extract_all(source, F.lit(SEGMENT), 0))
    df = boxed(items, _text=F.col(text)).filter(F.length(F.trim(F.regexp_replace(source, r"\s+", " "))) > 0)
    df = df.select("*", F.inline(F.array(F.struct(segments.alias("_segments"), over.alias("_over")))))
    solid = F.filter(F.col("_segments"), lambda s: s.rlike(r"(?U)\S"))
    blocks = F.transform(solid, lambda s: F.octet_length(F.regexp_replace(s, _AFTER_BLOCK, "")))
    marked = F.array_join(
        F.transform("_segments", lambda s: F.when(s.endswith("\n"), F.concat(_bytes(s).substr(F.lit(1), F.octet_length(s) - 1), F.lit(_MARK))).otherwise(_bytes(s))),
        "",
    )
    cores = F.regexp_extract_all(marked, F.lit(core_pattern(limit - overlap - 3, overlap + 3)), 0)
    df = df.select("*", F.inline(F.array(F.struct(blocks.alias("_blocks"), cores.alias("_cores"))))).drop("_segments")
    inside = r"(?![\x80-\xBF])"  # what follows begins a character
    skip = rf"^(?:[\s\S]{{3}}{inside}|[\s\S]{{2}}{inside}|[\s\S]{inside})"
    shared = lambda core: F.regexp_replace(F.right(core, F.lit(overlap + 3)), skip, "")
    pieces = F.transform("_cores", lambda c, i: _text(F.translate(F.concat(F.when(i > 0, shared(F.get("_cores", i - 1))).otherwise(""), c), _MARK, "\n")))
    sizes = F.transform("_cores", lambda c, i: F.when(i > 0, F.length(shared(F.get("_cores", i - 1)))).otherwise(0))  # a character is a byte here
    uncut = ~F.col("_over")
    return unboxed(df, items, blocks=F.col("_blocks"), pieces=F.when(uncut, F.array(source)).otherwise(pieces), shared=F.when(uncut, F.array(F.lit(0))).otherwise(sizes))


def pieces_of(split: DataFrame, keys: list[str]) -> DataFrame:
    """One row per piece, numbered from 1; ``n_shared`` of its ``n_bytes`` stand in the piece before it as well."""
    return split.select(*keys, F.size("pieces").alias("n_pieces"), F.posexplode(F.arrays_zip("pieces", "shared")).alias("_p", "_x")).select(
        *keys, (F.col("_p") + 1).alias("piece_no"), "n_pieces", F.octet_length("_x.pieces").alias("n_bytes"), F.col("_x.shared").alias("n_shared"), F.col("_x.pieces").alias("piece")
    )


def put_together(split: DataFrame, text: str, limit: int) -> DataFrame:
    """Checks the pieces of each item: n_pieces, n_bytes (without what is shared), restored (the pieces
    without their shared beginnings give the item back), within (no piece is over the limit)."""
    whole = _text(F.array_join(F.transform("pieces", lambda p, i: F.substr(_bytes(p), F.get("shared", i) + 1, F.octet_length(p))), ""))
    longest = F.array_max(F.transform("pieces", lambda p: F.octet_length(p)))
    return split.select("*", F.size("pieces").alias("n_pieces"), F.octet_length(whole).alias("n_bytes"), (whole == F.col(text)).alias("restored"), (longest <= limit).alias("within"))


def oversized(split: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """block_no 0 for each item that was cut and the number of each of its blocks over the limit."""
    numbers = F.filter(F.transform("blocks", lambda n, i: F.when(n > limit, i + 1).cast("int")), lambda x: x.isNotNull())
    return split.filter(F.size("pieces") > 1).select(*keys, F.explode(F.concat(F.array(F.lit(0)), numbers)).alias("block_no"))
