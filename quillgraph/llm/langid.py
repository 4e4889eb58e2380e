"""Language identification by a small convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over windows of a fixed length, each filter keeps its largest
response in the window, and a softmax gives the languages. For use the trained filters are folded into tables by byte
pair, so a window costs one table lookup per byte. A text's score is the mean of its windows' probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    emb: np.ndarray  # 256 x d
    conv: list[np.ndarray]  # per width: width x d x filters
    bias: list[np.ndarray]
    out: np.ndarray  # filters of all widths x languages
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By byte pair: [width 2 | first two of width 3 | first two of 4 | last two of 4], and the third byte of width 3."""
        e, (c2, c3, c4) = self.emb, self.conv
        pair = lambda w: ((e @ w[0])[:, None, :] + (e @ w[1])[None, :, :]).reshape(65536, -1)
        return np.hstack([pair(c2), pair(c3[:2]), pair(c4[:2]), pair(c4[2:])]).astype(np.float32), (e @ c3[2]).astype(np.float32), np.concatenate(self.bias).astype(np.float32)


def windows(raw: bytes) -> np.ndarray:
    """All bytes in rows of WINDOW: the last row ends with the text and may overlap the one before; short texts get zeros."""
    if len(raw) <= WINDOW:
        return np.frombuffer(raw.ljust(WINDOW, b"\0"), np.uint8).reshape(1, WINDOW)
    n = len(raw) // WINDOW
    rows = np.frombuffer(raw[: n * WINDOW], np.uint8).reshape(n, WINDOW)
    return rows if n * WINDOW == len(raw) else np.vstack([rows, np.frombuffer(raw[-WINDOW:], np.uint8)])


def train(data: np.ndarray, labels: np.ndarray, langs: list[str], steps: int = 400, batch: int = 64, rate: float = 0.01, dim: int = 8, seed: int = 5) -> Model:
    """Adam on cross-entropy; data: windows x WINDOW bytes, labels: positions in langs."""
    rng = np.random.default_rng(seed)
    k = len(langs)
    p = [rng.normal(0, 0.3, (256, dim))] + [rng.normal(0, 0.5 / np.sqrt(w), (w, dim, FILTERS)) for w in WIDTHS] + [np.zeros(FILTERS) for _ in WIDTHS] + [rng.normal(0, 0.2, (FILTERS * len(WIDTHS), k)), np.zeros(k)]
    m1, m2 = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    by = [np.flatnonzero(labels == i) for i in range(k)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(by[i % k], 1) for i in range(batch)])
        x, y = data[pick], labels[pick]
        emb, convs, biases, out, ob = p[0], p[1:4], p[4:7], p[7], p[8]
        e = emb[x]
        best, where = [], []
        for w, c, b in zip(WIDTHS, convs, biases):
            z = sum(e[:, i : WINDOW - w + 1 + i] @ c[i] for i in range(w)) + b
            at = z.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0])
        h = np.hstack(best)
        a = np.maximum(h, 0)
        s = a @ out + ob
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(batch), y] -= 1
        s /= batch
        g = [np.zeros_like(emb)] + [np.zeros_like(c) for c in convs] + [None] * 3 + [a.T @ s, s.sum(0)]
        gh = (s @ out.T) * (h > 0)
        for j, (w, c) in enumerate(zip(WIDTHS, convs)):
            gj = gh[:, j * FILTERS : (j + 1) * FILTERS]
            g[4 + j] = gj.sum(0)
            for i in range(w):
                seen = x[np.arange(batch)[:, None], where[j] + i]  # batch x filters
                g[1 + j][i] = np.einsum("bfd,bf->df", emb[seen], gj)
                np.add.at(g[0], seen, gj[:, :, None] * c[i].T[None])
        for i, d in enumerate(g):
            m1[i] = 0.9 * m1[i] + 0.1 * d
            m2[i] = 0.999 * m2[i] + 0.001 * d * d
            p[i] = p[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, p[0], p[1:4], p[4:7], p[7], p[8])


def fit(docs: DataFrame, learn: Column, rows_per_lang: int = 400, windows_per_row: int = 6, most_langs: int = 200, seed: int = 5) -> Model:
    """Train on a bounded sample: of each of at most `most_langs` most frequent languages, the `rows_per_lang` distinct
    rows with the smallest seeded hash among those that `learn` admits, and `windows_per_row` windows spread over each
    whole text. Labels beyond these languages are never predicted.

    Rows that repeat id, language and text are one, in the counts as well. Only rows whose hash is in the part of its
    range that holds four times as many distinct rows on average are ranked (all, where there are fewer), so a language
    that most rows have is not sorted in one task.
    """
    fine = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
    h = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    distinct = fine.select("lang", h.alias("h")).distinct()
    common = F.broadcast(distinct.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs))
    part = F.lit(4.0 * rows_per_lang) / F.col("count")
    near = distinct.join(common, "lang").where((F.col("h").cast("double") + 2.0**63) / 2.0**64 <= part).select("lang", "h")
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= rows_per_lang)
    first = first.select("h").distinct()  # rows_per_lang * most_langs numbers at most

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for h, lang, text in zip(b.h, b.lang, b.text):
                if LETTER.search(text):
                    w = windows(text.encode("utf-8", "replace"))
                    rows += [(h, i, lang, w[i].tobytes()) for i in sorted({int(i) for i in np.linspace(0, len(w) - 1, windows_per_row)})]
            yield pd.DataFrame(rows, columns=["h", "i", "lang", "w"])

    sample = fine.withColumn("h", h).join(F.broadcast(first), "h").select("h", "lang", "text").dropDuplicates(["h", "lang"])
    part = sample.mapInPandas(lean(cut), "h long, i int, lang string, w binary").toPandas()
    part = part.drop_duplicates(["h", "i", "lang"]).sort_values(["lang", "h", "i"])
    langs = sorted(part.lang.unique().tolist())
    if not langs:
        return Model([], np.zeros((256, 1)), [], [], np.zeros((1, 0)), np.zeros(0))
    data = np.frombuffer(b"".join(part.w), np.uint8).reshape(len(part), WINDOW)
    return train(data, part.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(), langs, seed=seed)


class Predictor:
    """The folded tables at work in a task."""

    def __init__(self, model: Model):
        self.langs, self.out, self.out_bias = model.langs, model.out.astype(np.float32), model.out_bias.astype(np.float32)
        if model.langs:
            self.pair, self.third, self.bias = model.tables()

    def _pooled(self, w: np.ndarray) -> np.ndarray:
        n, f = len(w), FILTERS
        flat = w.reshape(-1)
        idx = np.zeros(len(flat), np.int32)
        idx[:-1] = flat[:-1]
        idx *= 256
        idx[:-1] += flat[1:]
        t = np.take(self.pair, idx, axis=0).reshape(n, WINDOW, 4 * f)
        best2 = t[:, :-1, :f].max(1)
        best3 = (t[:, :-2, f : 2 * f] + np.take(self.third, w[:, 2:], axis=0)).max(1)
        best4 = (t[:, :-3, 2 * f : 3 * f] + t[:, 2:-1, 3 * f :]).max(1)
        return np.maximum(np.hstack([best2, best3, best4]) + self.bias, 0)

    def __call__(self, texts: list[str | None], rows: int = 256) -> tuple[list[str], list[float]]:
        """Language and score of whole texts; texts that are null or have no letter: UNKNOWN, 0."""
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        real = [i for i, x in enumerate(texts) if x is not None and LETTER.search(x)] if self.langs else []
        held: list[np.ndarray] = []
        owner: list[int] = []
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))

        def flush() -> None:
            w = np.concatenate(held)
            own = np.repeat([o for o in owner], [len(x) for x in held])
            for a in range(0, len(w), rows):
                s = self._pooled(w[a : a + rows]) @ self.out + self.out_bias
                s = np.exp(s - s.max(1, keepdims=True))
                np.add.at(sums, own[a : a + rows], s / s.sum(1, keepdims=True))
            held.clear()
            owner.clear()

        size = 0
        for i in real:
            w = windows(texts[i].encode("utf-8", "replace"))
            held.append(w)
            owner.append(i)
            counts[i] = len(w)
            size += len(w)
            if size >= 4096:
                flush()
                size = 0
        if held:
            flush()
        for i in real:
            mean = sums[i] / counts[i]
            j = int(mean.argmax())
            lang[i], score[i] = self.langs[j], float(min(1.0, mean[j]))
        return lang, score


def predict_column(model: Model, text: str = "text") -> Column:
    """A struct<lang_pred, score> column of whole texts."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            at = Predictor(model)
            for s in batches:
                lang, score = at(s.where(s.notna(), None).tolist())
                yield pd.DataFrame({"lang_pred": lang, "score": score})

        yield from lean(told)(parts)

    return predict(F.col(text))


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id's digits leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Learns from the text and language of rows that are not held out; a row with null doc_id is not held out. Null text,
    empty text and text without letters: `und`, 0. Without any labelled row to learn from, every row is `und`. Repeated
    rows each give a row; other columns than doc_id, text and lang are not read; an empty table gives no rows.
    """
    model = fit(docs, ~held_out())
    return docs.select("doc_id", held_out().alias("held_out"), predict_column(model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
