"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes (A-Z lower-cased) are embedded, filters of several widths run over windows of fixed length, each filter's maximum
feeds a softmax, and a document's probabilities are the mean over all its windows, weighted by their bytes. The training
sample is bounded by `per_lang` windows for each language and `most_rows` in all; prediction reads every whole text.

Defined cases: a null text, or one without a letter, is `und` with score 0; without any labelled text everything is
`und`; null labels teach nothing; a document without an identifier is never held out; repeated rows get the same answer;
an empty table gives an empty result; a very long text is read whole, window by window; further columns stay in `predict`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.session import ship

LENGTH, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4, 5), 12
SPAN = max(WIDTHS)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def windows(data: bytes) -> np.ndarray:
    """The whole of data as rows of LENGTH bytes, zeros behind the last."""
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, LENGTH)


def _columns(x: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """For each window and place, the embeddings of SPAN bytes side by side."""
    e = np.ascontiguousarray(embed[x]).reshape(len(x), LENGTH * EMBED)
    n, s = len(x), e.strides
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (n, LENGTH - SPAN + 1, SPAN * EMBED), (s[0], s[1] * EMBED, s[1])))


class ByteConvNet:
    def __init__(self, langs: list[str], seed: int = 11):
        rng, self.langs = np.random.default_rng(seed), langs
        width = np.repeat(WIDTHS, FILTERS)
        self.mask = (np.arange(SPAN * EMBED)[:, None] < width[None, :] * EMBED).astype(np.float32)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "conv": (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32),
            "bias": np.zeros(len(width), np.float32),
            "out": rng.normal(0, 0.1, (len(width), len(langs))).astype(np.float32),
            "out_bias": np.zeros(len(langs), np.float32),
        }
        self.p["embed"][0] = 0

    def probabilities(self, x: np.ndarray, chunk: int = 128) -> np.ndarray:
        p, out = self.p, np.empty((len(x), len(self.langs)), np.float32)
        for i in range(0, len(x), chunk):
            c = _columns(x[i : i + chunk], p["embed"]).reshape(-1, SPAN * EMBED) @ p["conv"]
            top = np.maximum(c.reshape(-1, LENGTH - SPAN + 1, c.shape[1]).max(axis=1) + p["bias"], 0)
            z = top @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + chunk] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 13) -> ByteConvNet:
        rng, p = np.random.default_rng(seed), self.p
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                at = order[i : i + batch]
                grad = self._gradient(x[at], y[at])
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                p["conv"] *= self.mask
                p["embed"][0] = 0
        return self

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        cols = _columns(x, p["embed"])
        c = cols @ p["conv"]
        where, filters = c.argmax(axis=1), np.arange(c.shape[2])
        top = np.take_along_axis(c, where[:, None, :], axis=1)[:, 0, :] + p["bias"]
        seen = np.maximum(top, 0)
        z = seen @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(n), y] -= 1
        dz /= n
        dtop = (dz @ p["out"].T) * (top > 0)
        picked = cols[np.arange(n)[:, None], where]  # only the places of the maxima carry a gradient
        dconv = np.einsum("nfk,nf->kf", picked, dtop) * self.mask
        dcols = dtop[:, :, None] * p["conv"].T[filters][None]
        places = np.minimum(where[:, :, None] + np.arange(SPAN), LENGTH - 1)
        dembed = np.zeros_like(p["embed"])
        np.add.at(dembed, x[np.arange(n)[:, None, None], places].ravel(), dcols.reshape(-1, EMBED))
        return {"embed": dembed, "conv": dconv, "bias": dtop.sum(axis=0), "out": seen.T @ dz, "out_bias": dz.sum(axis=0)}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, per_lang: int = 1500, most_rows: int = 60_000, pieces: int = 3) -> ByteConvNet | None:
    """Learns from the text and lang of the documents that are not held out: up to `pieces` windows of a document, spread
    over its length, and of a language the `per_lang` windows that come first by hash."""
    text = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # Thinned by hash to a few times per_lang documents of a language first, so that what is ranked has a fixed size too.
    share = text.groupBy("lang").agg((F.lit(3.0 * per_lang) / F.count(F.lit(1))).alias("share"))
    drawn = F.pmod(F.xxhash64(F.lit("drawn"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # At most most_rows languages, so the side that is sent to all executors has a fixed size.
    share = share.orderBy("share", "lang").limit(most_rows)
    text = text.select("doc_id", "lang", "text").join(F.broadcast(share), "lang").filter(drawn < F.col("share"))
    n, at = F.octet_length("text"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))
    text = text.select("doc_id", "lang", F.col("text").cast("binary").alias("data"), n.alias("n"), at.alias("at")).filter(F.col("at") * LENGTH < F.col("n"))
    start = (F.col("at") * F.greatest(F.col("n") - LENGTH, F.lit(0)) / max(1, pieces - 1)).cast("int") + 1
    text = text.select("lang", F.substring("data", start, F.lit(LENGTH)).alias("data"), F.xxhash64("doc_id", "at").alias("dealt"))
    first = Window.partitionBy("lang").orderBy("dealt", "data")
    rows = text.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= per_lang).orderBy("rn", "lang").limit(most_rows).collect()
    langs = sorted({r.lang for r in rows})
    if not langs:
        return None
    x = np.stack([windows(bytes(r.data).translate(LOWER))[0] for r in rows])
    return ByteConvNet(langs).fit(x, np.array([langs.index(r.lang) for r in rows]))


def _judge(texts: list[str | None], net: ByteConvNet | None) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    at = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
    for first in range(0, len(at), 256):
        some = at[first : first + 256]
        data = [texts[i].encode("utf-8", "surrogatepass").translate(LOWER) for i in some]
        parts = [windows(d) for d in data]
        p = net.probabilities(np.concatenate(parts))
        weight = np.concatenate([np.minimum(LENGTH, len(d) - LENGTH * np.arange(len(w))) for d, w in zip(data, parts, strict=True)])
        ends = np.cumsum([0, *(len(w) for w in parts)])
        for k, i in enumerate(some):
            a, b = ends[k], ends[k + 1]
            mean = (p[a:b] * weight[a:b, None]).sum(axis=0, dtype=np.float64) / weight[a:b].sum()
            langs[i], scores[i] = net.langs[int(mean.argmax())], float(min(1.0, mean.max()))
    return langs, scores


def _judged(texts: pd.Series, net: ByteConvNet | None) -> pd.DataFrame:
    parts = [_judge(texts.iloc[i : i + 256].tolist(), net) for i in range(0, len(texts), 256)]
    return pd.DataFrame({"lang_pred": [x for langs, _ in parts for x in langs], "score": [x for _, scores in parts for x in scores]})


def predict(docs: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced. Only texts go to Python workers."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _judged(texts, shared.value)

    rows = docs.drop("lang_pred", "score").select(F.struct("*").alias("row"), judge(F.col("text")).alias("said"))
    return rows.select("row.*", "said.lang_pred", "said.score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, languages: tuple[str, ...] | None = None, share: float = 0.25) -> DataFrame:
    """The documents in one of `languages` (None: in any that was learned), all columns as they were. A document goes if it
    has no letter, if the network takes it for another language, or if its own is no likelier than `share` of the way from
    chance (one of as many languages as were learned) to certainty. All stay if no text is labelled, since there is nothing
    to judge by."""
    net = train(docs)
    if net is None:
        return docs
    ship(docs.sparkSession)
    shared, least = docs.sparkSession.sparkContext.broadcast(net), least_score(len(net.langs), share)
    wanted = set(net.langs if languages is None else languages)

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = _judged(texts, shared.value)
            yield found.lang_pred.isin(wanted) & (found.score >= least)

    return docs.filter(known(F.col("text")))


def least_score(langs: int, share: float) -> float:
    """The score that lies `share` of the way from an even answer among `langs` languages to a certain one; with one
    language every answer is certain."""
    return 1 / langs + share * (1 - 1 / langs)
