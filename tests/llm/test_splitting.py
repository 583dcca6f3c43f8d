import random

from paperloom.llm import splitting as s


def blocks(text):
    out, cur, mark = [], [], None
    for line in text.split("\n"):
        if mark is None and not line.strip():
            if cur:
                out.append("\n".join(cur))
            cur = []
            continue
        cur.append(line)
        if mark is None:
            mark = line[:3] if line[:3] in ("```", "~~~") else None
        elif line.startswith(mark):
            mark = None
    return out + (["\n".join(cur)] if cur else [])


def texts():
    rng = random.Random(2)
    words = ["plan", "größe", "監査", "запись", "a.", "end!", "x" * 30, "終わり。"]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            kind = rng.randrange(6)
            body = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
            parts.append({0: f"```\n{body}\n\n{body}\n```", 1: f"{body}\n{body}", 2: body.replace(" ", ""), 3: "   "}.get(kind, body))
        out.append(rng.choice(["\n\n", "\n \n", "\n"]).join(parts))
    return out + ["", " \n ", None, "é" * 700, "~~~\nopen " + "z" * 400, "word " * 20_000, "\n\n\n" + "line\n" * 5000]


def test_pieces_give_the_item_back(spark):
    limit, overlap = 300, 30
    rows = [(i, t, 7, "h") for i, t in enumerate(texts())]
    items = spark.createDataFrame(rows, "i int, item string, blocks int, _over string")
    split = s.split_items(items, "item", limit, overlap)
    got = {r.i: r for r in split.collect()}
    for i, text, *_ in rows:
        if text is None or not text.strip():
            assert i not in got
            continue
        data, pieces = text.encode(), [p.encode() for p in got[i].pieces]
        if len(data) <= limit:
            assert pieces == [data] and got[i].blocks is None
            continue
        assert got[i].blocks == [len(b.encode()) for b in blocks(text)]
        at = len(pieces[0])
        assert data.startswith(pieces[0])
        for p in pieces[1:]:
            shared = [o for o in range(overlap, overlap + 4) if data[at - o : at - o + len(p)] == p]
            assert shared and len(p) <= limit
            at += len(p) - shared[0]
        assert at == len(data)
    over = {(r.i, r.block_no) for r in s.oversized(split, ["i"], limit).collect()}
    assert over == {(i, k) for i, t, *_ in rows if t and len(t.encode()) > limit and t.strip() for k, b in enumerate([None, *blocks(t)]) if k == 0 or len(b.encode()) > limit}
    assert s.pieces_of(split, ["i"]).count() == sum(len(r.pieces) for r in got.values())


def test_last_characters_of_every_ending(spark):
    """Items one byte over the core, whose last byte is each of 0x80 to 0xBF (0x85 is a line end to a regular expression)."""
    last = [chr(0xC0 + k) if k < 64 else chr(0x3000 + k) for k in range(96)]
    rows = [(i, "a" * n + c) for i, c in enumerate(last) for n in (266, 267, 532, 533, 534, 535)]
    items = spark.createDataFrame(rows, "i int, item string")
    checked = s.put_together(s.split_items(items, "item", 300, 30), "item", 300).collect()
    assert len(checked) == len(rows) and all(r.restored and r.within for r in checked)


def test_sentences_end_with_an_ellipsis(spark):
    text = "one two three four five six seven eight… " * 20
    pieces = s.split_items(spark.createDataFrame([(text,)], "t string"), "t", 300, 30).first().pieces
    assert all(p.endswith("… ") for p in pieces)


def test_cut_at_blocks_not_in_code(spark):
    code = "```\n" + "code line\n\n" * 15 + "```"
    text = "first block. " * 8 + "\n\n" + code + "\n\n" + "last block. " * 8
    row = s.split_items(spark.createDataFrame([(text,)], "t string"), "t", 300, 30).first()
    assert row.pieces[0].endswith("first block. \n\n")


def test_empty_table(spark):
    split = s.split_items(spark.createDataFrame([], "t string"), "t", 300, 30)
    assert split.count() == 0 and s.oversized(split, [], 300).count() == 0
