"""Problem 3: personal information, by a character-level bidirectional LSTM with CRF transitions.

The model is trained by ``pii_train`` (numpy) from labelled spans; its weights lie beside this
module. Every text is cut into overlapping windows; the windows' scores are put together, each
believed up to the middle of an overlap, and the best path is found through the whole text at once,
so windows can't disagree. What is found, and where it begins and ends, is the network's decision
alone: no word list or pattern adds, moves or refuses a span (``kept`` says what little is checked)."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import spread

KINDS = ["email", "phone", "id_number", "address", "name"]
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: The tags in the decoder's order: O and the Bs, which any tag may come before, then the Is.
INNER = np.asarray([0, *range(1, len(TAGS), 2), *range(2, len(TAGS), 2)])
_FREE = 1 + len(KINDS)
#: What can't follow: an I after anything but the B or I of its kind.
BARRED = np.where([[b[0] == "I" and a[1:] != b[1:] for b in TAGS] for a in TAGS], np.float32(-1e4), np.float32(0))
WINDOW, OVERLAP = 256, 32
#: Windows to a batch; a batch is filled up, so its shape and with it every rounding is the same.
BATCH = 256
#: A text is decoded in pieces of so many characters, that share MARGIN characters with the next.
PIECE, MARGIN = 16384, 512
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

CLASSES = 8


def char_class(c: int) -> int:
    """Class of a code point that isn't among the model's characters."""
    if 0xAC00 <= c <= 0xD7A3:
        return 1
    if 0x61 <= c <= 0x7A:
        return 2
    if 0x41 <= c <= 0x5A:
        return 3
    if 0x30 <= c <= 0x39:
        return 4
    if 0x4E00 <= c <= 0x9FFF:
        return 5
    if 0x3130 <= c <= 0x318F:
        return 6
    return 7


def folded(points: np.ndarray) -> np.ndarray:
    """Code points with full-width ASCII as ASCII and odd spaces as spaces."""
    p = points.copy()
    wide = (p >= 0xFF01) & (p <= 0xFF5E)
    p[wide] -= 0xFEE0
    p[(p == 0x3000) | (p == 0xA0) | (p == 9) | (p == 13)] = 0x20
    return p


class Tagger:
    """Weights, and tagging of texts.

    Both directions run at once: the backward one reads each window from its end, so that what a
    short window is filled up with comes after it for either and changes nothing."""

    def __init__(self, w: dict[str, np.ndarray]) -> None:
        chars = w["chars"]
        top = int(max(chars.max(), 0xFFFF)) + 1
        self.ids = np.fromiter((char_class(c) for c in range(top)), np.int32, top)
        self.ids[chars] = np.arange(len(chars), dtype=np.int32) + CLASSES
        k = self.hidden = w["u"].shape[1]
        emb = w["emb"].astype(np.float32)
        # One product gives all gates from state, character and 1 (for the bias), one column for each
        # window. The cell and its candidate are held as halves (the candidate moved to 0 .. 1), so
        # that one clip serves all gates; the weights that read the state are doubled for it.
        half = np.repeat(np.asarray([1, 0.5], np.float32), [3 * k, k])[:, None]
        self.emb = np.ascontiguousarray(np.concatenate([emb, np.ones((len(emb), 1), np.float32)], 1).T)
        u, x, b = (w[name].astype(np.float32).transpose(0, 2, 1) for name in "uwb")
        self.mix = np.concatenate([2 * u * half, x * half, b * half], 2)
        self.mix[:, 3 * k :, -1] += 0.5
        self.out = np.ascontiguousarray(2 * w["out"].astype(np.float32).transpose(0, 2, 1)[:, INNER])
        # the tags' scores come with the gates of the step after
        self.mix = np.concatenate([self.mix, np.concatenate([self.out, np.zeros((2, len(TAGS), self.mix.shape[2] - k), np.float32)], 2)], 1)
        self.bias, self.trans = w["bias"].astype(np.float32)[INNER], (w["trans"].astype(np.float32) + BARRED)[INNER][:, INNER]
        self.state = np.zeros((2, self.mix.shape[2], BATCH), np.float32)
        self.g = np.empty((2, 4 * k + len(TAGS), BATCH), np.float32)
        self.c, self.new = np.empty((2, k, BATCH), np.float32), np.empty((2, k, BATCH), np.float32)

    def encode(self, text: str) -> np.ndarray:
        p = folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        return self.ids[np.where(p < len(self.ids), p, 0xFFFF)]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Scores (direction, time and batch, tags in INNER order) of ids (time, direction, batch)."""
        t, k = len(ids), self.hidden
        g, c, new, h = self.g, self.c, self.new, self.state[:, :k]
        gates, tags = g[:, : 4 * k], g[:, 4 * k :].transpose(0, 2, 1)
        gi, gf, go, gg = (g[:, i * k : (i + 1) * k] for i in range(4))
        read = [self.state[d, k:] for d in (0, 1)]
        e = np.empty((2, t, BATCH, len(TAGS)), np.float32)
        h[:], c[:] = 0, 0
        for i in range(t):
            for d in (0, 1):
                np.take(self.emb, ids[i, d], axis=1, out=read[d], mode="clip")
            np.matmul(self.mix, self.state, out=g)
            if i:
                e[:, i - 1] = tags
            np.clip(gates, 0, 1, out=gates)
            np.multiply(c, gf, out=c)
            np.subtract(gg, 0.5, out=new)
            np.multiply(gi, new, out=new)
            np.add(c, new, out=c)
            np.clip(c, -0.5, 0.5, out=c)
            np.multiply(go, c, out=h)
        e[:, t - 1] = np.matmul(self.out, h).transpose(0, 2, 1)
        return e.reshape(2, t * BATCH, len(TAGS))

    def emissions(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tag scores of every character of texts that lie one after the other in ``codes``, from
        overlapping windows: each is believed up to the middle of an overlap."""
        at, size, lead, tail = [], [], [], []
        for s, n in zip(starts.tolist(), sizes.tolist()):
            for a in range(0, max(1, n - OVERLAP), WINDOW - OVERLAP):
                m = min(WINDOW, n - a)
                at.append(s + a), size.append(m)
                lead.append(OVERLAP // 2 if a else 0), tail.append(0 if a + m == n else OVERLAP // 2)
        out = np.empty((len(codes), len(TAGS)), np.float32)
        at, size, lead, tail = (np.asarray(x, np.int64) for x in (at, size, lead, tail))
        order = np.argsort(size, kind="stable")
        # the batch that isn't full is the one of the shortest windows
        for b in range(-(-len(order) % BATCH), len(order), BATCH):
            part = order[max(b, 0) : b + BATCH]
            n, t = len(part), int(size[part[-1]])
            a, z = at[part], size[part]
            time = np.arange(t)[:, None]
            inside = time < z
            ids = np.zeros((t, 2, BATCH), np.int64)
            ids[:, 0, :n] = np.where(inside, codes[np.minimum(a + time, len(codes) - 1)], 0)
            ids[:, 1, :n] = np.where(inside, codes[np.maximum(a + z - 1 - time, 0)], 0)
            e = self.scores(ids)
            i, k = np.nonzero((time >= lead[part]) & (time < z - tail[part]))
            got = np.take(e[0], i * BATCH + k, axis=0)
            got += np.take(e[1], (z[k] - 1 - i) * BATCH + k, axis=0)
            out[a[k] + i] = got
        out += self.bias
        return out

    def viterbi(self, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best tags of every character, decoded over whole pieces (rows of e from a start on)."""
        got = np.zeros(len(e), np.int8)
        order = np.argsort(-sizes, kind="stable")
        to_free = np.ascontiguousarray(self.trans[:, :_FREE])[:, :, None]
        own = np.arange(len(KINDS))
        to_inner = np.stack([self.trans[1 + own, _FREE + own], self.trans[_FREE + own, _FREE + own]])[:, :, None]
        b = 0
        while b < len(order):
            t = int(sizes[order[b]])
            part = order[b : b + max(8, min(256, (1 << 19) // max(t, 1)))]
            b += len(part)
            n, long = len(part), sizes[part]
            active = (long[None, :] > np.arange(t)[:, None]).sum(1)  # the pieces are sorted, longest first
            rows = np.minimum(starts[part] + np.arange(t)[:, None], len(e) - 1)
            x = np.ascontiguousarray(np.take(e, rows.ravel(), axis=0).reshape(t, n, len(TAGS)).transpose(0, 2, 1))
            x[0, _FREE:] = -1e4
            step, best, held = (np.empty((*s, n), np.float32) for s in ((len(TAGS), _FREE), (len(TAGS),), (2, len(KINDS))))
            for i in range(1, t):  # x becomes the score of the best path up to i
                m = int(active[i])
                was, now = x[i - 1, :, :m], x[i, :, :m]
                np.add(was[:, None], to_free, out=step[:, :, :m])
                np.max(step[:, :, :m], axis=0, out=best[:_FREE, :m])
                np.add(was[1:].reshape(2, len(KINDS), m), to_inner, out=held[:, :, :m])
                np.max(held[:, :, :m], axis=0, out=best[_FREE:, :m])
                np.add(now, best[:, :m], out=now)
            tags = np.zeros((t, n), np.int8)
            cur = np.zeros(n, np.int64)
            for i in range(t - 1, -1, -1):
                m, on = int(active[i]), int(active[i + 1]) if i + 1 < t else 0
                if on:
                    cur[:on] = (x[i, :, :on] + self.trans[:, cur[:on]]).argmax(0)
                if m > on:
                    cur[on:m] = x[i, :, on:m].argmax(0)
                tags[i, :m] = cur[:m]
            for k, p in enumerate(part.tolist()):
                got[starts[p] : starts[p] + sizes[p]] = tags[: sizes[p], k]
        return INNER.astype(np.int8)[got]


@lru_cache(maxsize=2)
def tagger(weights: bytes) -> Tagger:
    """One in each worker process, from the bytes of the weights' file."""
    with np.load(io.BytesIO(weights)) as w:
        return Tagger({k: w[k] for k in w.files})


def tag_texts(t: Tagger, texts: list[str], most: int = 1 << 20) -> list[np.ndarray]:
    """Tags of every character of every text: the scores of overlapping windows are put together,
    and one best path is found through the whole text (of texts longer than PIECE, through pieces
    that share a margin). A text's tags don't depend on the texts beside it."""
    out = [np.zeros(len(x), np.int8) for x in texts]
    pieces: list[tuple[int, int, int, int, np.ndarray]] = []
    held = 0

    def decode() -> None:
        sizes = np.asarray([len(c) for *_, c in pieces], np.int64)
        starts = np.cumsum(sizes) - sizes
        e = t.emissions(np.concatenate([c for *_, c in pieces]), starts, sizes)
        tags = t.viterbi(e, starts, sizes)
        for (i, a, end, lead, _), s in zip(pieces, starts.tolist()):
            out[i][a:end] = tags[s + lead : s + lead + end - a]
        pieces.clear()

    for i, x in enumerate(texts):
        for a in range(0, len(x), PIECE):
            lead, end = min(a, MARGIN), min(len(x), a + PIECE)
            pieces.append((i, a, end, lead, t.encode(x[a - lead : end + MARGIN])))
            held += end - a
            if held >= most:
                decode()
                held = 0
    if pieces:
        decode()
    return out


def decoded_spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of runs of one kind; a B within begins another."""
    at = np.flatnonzero(tags)
    out: list[tuple[int, int, int]] = []
    for i, t in zip(at.tolist(), tags[at].tolist()):
        k = (t - 1) // 2
        if t % 2 == 0 and out and out[-1][0] == k and out[-1][2] == i:
            out[-1] = (k, out[-1][1], i + 1)
        else:
            out.append((k, i, i + 1))
    return out


def kept(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of decoded spans, without spaces at either end. The only check: a span
    holds what its kind can't be without, letters for a name or address of mail, a digit (spoken
    ones count for a phone) else, and a name at least two letters."""
    out = []
    for k, s, e in spans:
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1].isspace():
            e -= 1
        x, kind = text[s:e], KINDS[k]
        letters, digits = sum(map(str.isalpha, x)), sum(map(str.isdigit, x))
        if (letters >= 2 and not digits) if kind == "name" else letters >= 2 and len(x) >= 5 if kind == "email" else (digits >= 7 or letters >= 7) if kind == "phone" else digits >= 1 if kind == "address" else digits >= 6:
            out.append((kind, s, e))
    return out


def find_spans(texts: list[str | None], weights: bytes) -> list[list[tuple[str, int, int]]]:
    """Personal information in each text; null and empty texts have none."""
    t = tagger(weights)
    have = [i for i, x in enumerate(texts) if x]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, g in zip(have, tag_texts(t, [texts[i] for i in have])):
        out[i] = kept(texts[i], decoded_spans(g))
    return out


def replaced(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span as its placeholder, otherwise unchanged."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in spans:
        out += [text[at:s], PLACEHOLDERS[kind]]
        at = e
    return "".join(out) + text[at:]


def fields(reports: DataFrame, articles: DataFrame) -> DataFrame:
    """field, id, text of the three fields, once for each distinct id and text of a delivery."""
    r = reports.select("id", F.explode(F.array(F.struct(F.lit("reports.content").alias("field"), F.col("content").alias("text")), F.struct(F.lit("reports.reporter_contact").alias("field"), F.col("reporter_contact").alias("text")))).alias("x")).select("x.field", "id", "x.text")
    a = articles.select(F.lit("articles.content").alias("field"), "id", F.col("content").alias("text"))
    return r.unionByName(a).filter("id is not null")


def _chunks(b, size: int = 4000) -> Iterator:
    for i in range(0, b.num_rows, size):
        yield b.slice(i, size)


def personal_spans(texts: DataFrame, weights: str | None = None) -> DataFrame:
    """field, id, start_at (from 1), span_len, kind for ``texts`` (field, id, text); distinct rows.

    Null and empty texts have none; very long ones are read window by window; rows delivered twice
    give their rows once."""
    model = Path(weights or WEIGHTS).read_bytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for b in _chunks(whole):
                got = find_spans(b.column(2).to_pylist(), model)
                row = [i for i, g in enumerate(got) for _ in g]
                flat = [x for g in got for x in g]
                at = pa.array(row, pa.int64())
                cols = [b.column(0).take(at), b.column(1).take(at), pa.array([s + 1 for _, s, _ in flat], pa.int64()), pa.array([e - s for _, s, e in flat], pa.int64()), pa.array([k for k, _, _ in flat], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["field", "id", "start_at", "span_len", "kind"])

    source = spread(texts.select("field", "id", "text"))
    return source.mapInArrow(run, "field string, id bigint, start_at bigint, span_len bigint, kind string").distinct()


def masked(texts: DataFrame, weights: str | None = None) -> DataFrame:
    """field, id, text with placeholders: one row per input row; null stays null."""
    model = Path(weights or WEIGHTS).read_bytes()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for b in _chunks(whole):
                raw = b.column(2).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([replaced(t, g) for t, g in zip(raw, find_spans(raw, model))], pa.string())], ["field", "id", "text"])

    return spread(texts.select("field", "id", "text")).mapInArrow(run, "field string, id bigint, text string")
