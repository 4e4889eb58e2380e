"""Parsers inside the row and batches of bytes, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.scalar import PARTICLES
from quillgraph.operators import threads, writes

PIECES = ["Ann Lee: hi", "ann: no", "Bo de Ray:\tyes", "Note", "Title One:", "a: b: c", "", "  ", "cout << x", "o", "c", "\\n", "\\t", "x\\r\\ny", "Élan: ça", "A" * 41 + ": long", "Van Ann:  two  ", "Key 2:", "1:", ":", "Ann Lee:x", "Ann  Lee: gap"]


def sections(text, opens):
    text = re.sub(r"\\r\\n|\\n", "\n", text).replace("\\t", "\t")
    out, seq = {0: ["", []]}, 0
    for line in text.split("\n"):
        found = opens(line)
        if found:
            seq += 1
            out[seq] = [found[0], [found[1]]]
        else:
            out[seq][1].append(line)
    return [(s, h, re.sub(r"^[ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+$", "", "\n".join(b))) for s, (h, b) in out.items()]


def speaker(line):
    m = re.fullmatch(r"([^:]{1,40}):[ \t]+(.*)", line)
    word = r"[A-ZÉ][^\W\d_’'.-]*"
    return m.groups() if m and re.fullmatch(rf"\s*{word}(\s+({word}|(?i:{'|'.join(PARTICLES)}))){{0,3}}\s*", m[1]) else None


def title(line):
    m = re.fullmatch(r"([A-Z][A-Za-z0-9 _-]{0,40}):", line)
    return (m[1], "") if m else None


def test_parsers_inside_the_row(spark):
    rnd = random.Random(11)
    texts = ["", "\n", "Ann Lee: x", *["\n".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 12))) for _ in range(300)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9999, None)], "id long, text string")
    chats, fields = threads.chat_messages(df), threads.field_sections(df)
    assert sorted(tuple(r) for r in chats.collect()) == sorted((i, s, h, b) for i, t in enumerate(texts) for s, h, b in sections(t, speaker) if b)
    assert sorted(tuple(r) for r in fields.collect()) == sorted((i, s, h, b) for i, t in enumerate(texts) for s, h, b in sections(t, title) if b or h)
    for plan in (chats, fields, threads.email_messages(df)):
        assert "Exchange" not in plan._jdf.queryExecution().toString()


def greedy(sizes, most_bytes, most_rows):
    batch, size, n, out = 0, 0, 0, []
    for b in sizes:
        b = b or 0
        if n and (size + b > most_bytes or n >= most_rows):
            batch, size, n = batch + 1, 0, 0
        size, n = size + b, n + 1
        out.append(batch)
    return out


@pytest.mark.parametrize("block,most_rows", [(65536, 4), (7, 4), (16, 50), (1, 3)])
def test_batches_in_blocks(spark, block, most_rows):
    """One part has most rows, and is cut into many blocks; batches may be longer than a block."""
    rnd = random.Random(block)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None, "b"]), i, rnd.choice([None, 0, 1, 2, 3, 9, 40])) for i in range(400)]
    df = spark.createDataFrame([(p, i, b, "x") for p, i, b in rows], "part string, ord long, bytes long, size string").repartition(3)
    got = {r.ord: r.batch for r in writes.size_batches(df, 12, most_rows, block).collect()}
    for part in {p for p, _, _ in rows}:
        mine = [(i, b) for p, i, b in rows if p == part]
        assert [got[i] for i, _ in mine] == greedy([b for _, b in mine], 12, most_rows)
    assert writes.size_batches(df.limit(0), 12, 4).count() == 0
