"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time. It labels every byte with
probabilities of the learned languages; a document's probabilities are their mean over all of its bytes.
Texts are cut into blocks of BLOCK bytes, whose states start anew, so that thousands of blocks of many documents
advance together, one byte at a time, and a very long text is only more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rutine.llm.common import arrow_batches, lean_batches, table

#: Bytes after which the states start anew.
BLOCK = 128
#: Units of each direction.
UNITS = 8
#: Labelled documents that training may use for each language, at most, and pieces of each, of so many characters.
DOCUMENTS_EACH, PIECES, PIECE_CHARS = 250, 4, 160
#: Labelled documents that training may use in all, at most, but for one of each language: with very many languages there are fewer of each.
DOCUMENTS = 50_000
#: Blocks that advance together, times languages, beyond 16 of these.
TOGETHER = 2048
UNKNOWN = "und"


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """A gated recurrent layer that reads bytes (time, many) in the order given."""

    NAMES = ("e", "u", "b")

    def __init__(self, units: int, rng):
        self.h = units
        self.e = rng.normal(0, 0.3, (256, 3 * units)).astype(np.float32)  # inputs of update, reset and new state by byte
        self.u = rng.normal(0, units**-0.5, (units, 3 * units)).astype(np.float32)
        self.b = np.zeros(units, np.float32)

    def forward(self, x: np.ndarray):
        """States (time, many, units) and what backward() needs."""
        h, (t, n) = self.h, x.shape
        state, kept = np.zeros((t + 1, n, h), np.float32), []
        for i in range(t):
            a, r_ = self.e[x[i]], state[i] @ self.u
            z, r = sigmoid(a[:, :h] + r_[:, :h]), sigmoid(a[:, h : 2 * h] + r_[:, h : 2 * h])
            m = r_[:, 2 * h :] + self.b
            new = np.tanh(a[:, 2 * h :] + r * m)
            state[i + 1] = new + z * (state[i] - new)
            kept.append((z, r, m, new))
        return state, kept

    def backward(self, x, state, kept, d_state) -> dict[str, np.ndarray]:
        """Gradients by parameter for the gradients of all states (time, many, units)."""
        h = self.h
        d, du, db, da = np.zeros_like(d_state[0]), np.zeros_like(self.u), np.zeros_like(self.b), []
        for i in range(len(x) - 1, -1, -1):
            z, r, m, new = kept[i]
            d = d + d_state[i]
            dn = d * (1 - z) * (1 - new * new)
            dz = d * (state[i] - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            back = np.concatenate([dz, dr, dm], axis=1)
            du += state[i].T @ back
            db += dm.sum(axis=0)
            da.append(np.concatenate([dz, dr, dn], axis=1))
            d = d * z + back @ self.u.T
        flat, da = x[::-1].ravel(), np.concatenate(da)
        de = np.stack([np.bincount(flat, da[:, j], 256) for j in range(3 * h)], axis=1).astype(np.float32)
        return {"e": de, "u": du, "b": db}


class Network:
    """Both directions and a softmax over languages at every byte."""

    def __init__(self, languages: list[str], units: int = UNITS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.ahead, self.back = Direction(units, rng), Direction(units, rng)
        self.w = rng.normal(0, 0.3, (2 * units, len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.015, seed: int = 5) -> None:
        """x: bytes (blocks, time); mask: which are there; y: language of each block. Adam on the mean loss of all bytes."""
        rng, moments, step = np.random.default_rng(seed), {}, 0
        total = epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                xs, ms = np.ascontiguousarray(x[some].T), mask[some].T[:, :, None]
                fs, fk = self.ahead.forward(xs)
                rs, rk = self.back.forward(xs[::-1])
                states = np.concatenate([fs[1:], rs[:0:-1]], axis=2)
                p = self._softmax(states @ self.w + self.c)
                p[:, np.arange(len(some)), y[some]] -= 1
                p *= ms / ms.sum()
                grads = {("", "w"): np.tensordot(states, p, ((0, 1), (0, 1))), ("", "c"): p.sum(axis=(0, 1))}
                d = p @ self.w.T
                h = self.ahead.h
                grads |= {("ahead", k): g for k, g in self.ahead.backward(xs, fs, fk, d[:, :, :h]).items()}
                grads |= {("back", k): g for k, g in self.back.backward(xs[::-1], rs, rk, d[::-1, :, h:]).items()}
                step += 1
                pace = rate * min(1, 2 * (1 - (step - 1) / total))
                for (part, name), g in grads.items():
                    owner = getattr(self, part) if part else self
                    m, v = moments.setdefault((part, name), (np.zeros_like(g), np.zeros_like(g)))
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    getattr(owner, name).__isub__((pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32))

    @staticmethod
    def _softmax(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(axis=-1, keepdims=True))
        return a / a.sum(axis=-1, keepdims=True)

    def _logits(self, part: Direction, x: np.ndarray, w: np.ndarray, out: np.ndarray, order) -> None:
        """Add a direction's share of the logits (languages, time, many) to out, holding one state at a time."""
        h, n = part.h, x.shape[1]
        e, u = part.e.copy(), part.u.copy()
        e[:, : 2 * h] *= 0.5  # sigmoid by tanh of the half
        u[:, : 2 * h] *= 0.5
        state, a, r_ = np.zeros((n, h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, 3 * h), np.float32)
        for i in order:
            np.take(e, x[i], axis=0, out=a)
            np.matmul(state, u, out=r_)
            gate = a[:, : 2 * h] + r_[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            new = r_[:, 2 * h :] + part.b
            new *= gate[:, h:]
            new += a[:, 2 * h :]
            np.tanh(new, out=new)
            state -= new
            state *= gate[:, :h]
            state += new
            out[:, i] += w.T @ state.T

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (languages, time, many) of every byte of blocks x (time, many)."""
        out = np.empty((len(self.languages), *x.shape), np.float32)
        out[:] = self.c[:, None, None]
        h = self.ahead.h
        self._logits(self.ahead, x, self.w[:h], out, range(len(x)))
        self._logits(self.back, x, self.w[h:], out, range(len(x) - 1, -1, -1))
        out -= out.max(axis=0)
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out

    def pooled(self, texts: list[bytes], labels: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(mean probabilities, label of each byte) of each text. An empty text has zeros."""
        sums, runs = np.zeros((len(texts), len(self.languages))), [[] for _ in texts]
        for x, owner, length in blocks(texts, together=max(16, TOGETHER * 16 // max(16, len(self.languages)))):
            p = self.label(x)
            if length[-1] < len(x):
                p *= np.arange(len(x))[:, None] < length
            np.add.at(sums, owner, p.sum(axis=1).T)
            if labels:
                best = p.argmax(axis=0).astype(np.uint32)
                for j, o in enumerate(owner):
                    runs[o].append(best[: length[j], j])
        for i, text in enumerate(texts):
            yield sums[i] / max(1, len(text)), (np.concatenate(runs[i]) if runs[i] else np.zeros(0, np.uint32)) if labels else None


def blocks(texts: list[bytes], size: int = BLOCK, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of all texts, some at a time: bytes (time, many), the text of each, the length of each.

    Short blocks, the last of each text, come together after the full ones."""
    spans = np.array([(i, a, min(a + size, len(t))) for i, t in enumerate(texts) for a in range(0, len(t), size)], np.int64).reshape(-1, 3)
    spans = spans[np.argsort(spans[:, 1] - spans[:, 2], kind="stable")]  # long ones first, so that short ones share a matrix
    for at in range(0, len(spans), together):
        some = spans[at : at + together]
        length = some[:, 2] - some[:, 1]
        x = np.zeros((len(some), int(length[0])), np.uint8)
        for j, (i, a, b) in enumerate(some.tolist()):
            x[j, : b - a] = np.frombuffer(texts[i], np.uint8, b - a, a)
        yield np.ascontiguousarray(x.T), some[:, 0], length


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", documents_each: int = DOCUMENTS_EACH, pieces: int = PIECES, piece_chars: int = PIECE_CHARS) -> Network:
    """A network learned from a bounded sample: at most documents_each texts of each language and DOCUMENTS in all, and of each text
    `pieces` pieces of piece_chars characters, at places chosen by its hash. Predictions always read whole texts.

    The texts are those with the smallest hashes of id and text, so reruns agree. Rows with a null text or language teach nothing.
    Without any labelled text the network knows no language and rejects everything."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)).alias("h"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Network([])
    documents_each = max(1, min(documents_each, DOCUMENTS // len(counts)))
    # hashes are uniform: the share of them that gives some more texts than are wanted
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (1.3 * documents_each + 20) / n))])
    some = rows.where(F.col("h").cast("double") / 2.0**63 < 2 * F.element_at(shares, F.col("lang")) - 1)
    places = [F.pmod(F.xxhash64("h", F.lit(j)), F.greatest(F.length("text") - piece_chars, F.lit(1))) for j in range(pieces)]
    cut = F.array(*[F.substring(F.col("text"), p.cast("int") + 1, F.lit(piece_chars)) for p in places])
    got: dict[str, list] = {}
    for r in sorted(some.select("lang", "h", cut.alias("pieces")).collect(), key=lambda r: (r.lang, r.h)):
        if len(got.setdefault(r.lang, [])) < documents_each:
            got[r.lang].append([p.encode() for p in r.pieces])
    languages = sorted(counts)
    net, xs, ms, ys = Network(languages), [], [], []
    for y, lang in enumerate(languages):
        texts = [p for d in got.get(lang, []) for p in d]
        for x, _, length in blocks(texts):
            full = np.zeros((BLOCK, x.shape[1]), np.uint8)
            full[: len(x)] = x
            xs.append(full.T)
            ms.append((np.arange(BLOCK)[None, :] < length[:, None]).astype(np.float32))
            ys.append(np.full(x.shape[1], y))
    net.fit(np.concatenate(xs), np.concatenate(ms), np.concatenate(ys))
    return net


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """The language of every text: (id, lang_pred, score), and with spans also runs of equally labelled bytes.

    One row for each row of docs. A text that is null, empty or without a letter is UNKNOWN with score 0, as is everything if the
    network knows no language. score is the mean probability of lang_pred over the text's bytes. runs is an array of (start, end, lang)
    in bytes, end exclusive. No shuffle; the network, a few dozen kilobytes whatever the input, goes with the code."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for b in batches:
            texts = [x if x and net.languages and any(map(str.isalpha, x)) else "" for x in b.column(1).to_pylist()]
            lang, score, runs = [], [], []
            for text, (p, labels) in zip(texts, net.pooled([x.encode() for x in texts], spans), strict=True):
                best = int(p.argmax()) if text else -1
                lang.append(net.languages[best] if text else UNKNOWN)
                score.append(min(1.0, float(p[best])) if text else 0.0)
                if spans:
                    cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                    runs.append([{"start": a, "end": z, "lang": net.languages[labels[a]]} for a, z in zip(cut, cut[1:], strict=False) if z > a])
            out = [b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(runs, run_type)] if spans else out, names=["id", "lang_pred", "score", "runs"][: 3 + spans])

    schema = f"id {kind}, lang_pred string, score double" + ", runs array<struct<start:int,end:int,lang:string>>" * spans
    return rows.mapInArrow(lean_batches(run), schema).withColumnRenamed("id", id_col)


def with_language(docs: DataFrame, net: Network, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the two columns of identify() under the given names, which docs must not have; all other columns pass through, repeated rows and null ids too."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    kinds = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches):
        for b in batches:
            texts = [x if x and net.languages and any(map(str.isalpha, x)) else "" for x in b.column(at).to_pylist()]
            best = [(net.languages[int(p.argmax())], min(1.0, float(p.max()))) if x else (UNKNOWN, 0.0) for x, (p, _) in zip(texts, net.pooled([x.encode() for x in texts]), strict=True)]
            lang, score = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=kinds.names)

    return docs.mapInArrow(lean_batches(run), kinds)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_bidirectional_gru(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    net = train(docs.where(~held_out()))
    return identify(docs, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
