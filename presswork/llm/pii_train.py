"""Training of the tagger in ``pii``: ``python -m presswork.llm.pii_train DIR OUT [STEPS WORKERS [START]]``.

TEXTS texts are drawn at random (seeded) from the tables in DIR, the bound whatever their size.
Where personal information may stand in them is guessed by the shapes in ``pii_forms``; most of
what stands there is then replaced by values drawn from ``pii_values``, and made-up sentences with
and without values are put between the texts' own. So the network sees values of many forms, known
to begin and end where they do, in the surroundings of the corpus; it is alone in deciding later.

START: weights to begin with instead of random ones. Gradients are summed over WORKERS forked processes; the order of sums is fixed, so a run with the
same number of workers gives the same weights."""

from __future__ import annotations

import os
import sys
from collections import Counter

os.environ.setdefault("OMP_NUM_THREADS", "1")

import numpy as np  # noqa: E402
import regex  # noqa: E402

from presswork.llm import pii_forms as forms  # noqa: E402
from presswork.llm.pii import BARRED, CLASSES, KINDS, TAGS, WINDOW, char_class, folded  # noqa: E402
from presswork.llm.pii_values import Values  # noqa: E402

TEXTS, VALID = 9000, 700
CHARS, EMB, HIDDEN = 1400, 24, 32
#: Chance that a span is replaced, that a sentence is put in, and that a syllable is made unknown.
REPLACED, PUT_IN, UNKNOWN = 0.6, 0.35, 0.03
#: Greatest step of Adam.
RATE = 5e-3


def given_names(reporters: list[str], texts: list[str], least: int = 8) -> set[str]:
    """Given names: of reporters, and of who stands before a title in the texts."""
    got = {m[1] for r in reporters if (m := regex.fullmatch(rf"\s*[{forms.FAMILY_COMMON}]([가-힣]{{2}})(?:\s*기자)?\s*", r or ""))}
    titled = regex.compile(rf"(?<![가-힣])[{forms.FAMILY_COMMON}]([가-힣]{{2}})\s?(?:씨[는가]|기자|주무관[은이]|센터장[은이]|과장[은이]|교장[은이]|연구원[은이])")
    n = Counter(m[1] for t in texts for m in titled.finditer(t))
    return got | {g for g, k in n.items() if k >= least}


def guessed(text: str, names: regex.Pattern) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the shapes in a text, without overlaps, in order."""
    taken = np.zeros(len(text), bool)
    got = []
    shapes = [(k, forms.FORMS[k]) for k in ("email", "address", "id_number", "phone")] + [("name", forms.LATIN_NAME), ("name", names)]
    for kind, p in shapes:
        for m in p.finditer(text):
            s, e = m.span()
            if not taken[s:e].any() and not (kind == "name" and forms.NOT_A_PERSON.match(text, e)):
                taken[s:e] = True
                got.append((KINDS.index(kind), s, e))
    return sorted(got, key=lambda x: x[1])


def tagged(parts: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """Text and tags of parts (kind or '', text)."""
    tags = []
    for kind, t in parts:
        k = 1 + 2 * KINDS.index(kind) if kind else 0
        tags += [k, *[k + 1] * (len(t) - 1)] if kind else [0] * len(t)
    return "".join(t for _, t in parts), np.asarray(tags, np.int8)


def varied(text: str, spans: list[tuple[int, int, int]], v: Values) -> list[tuple[str, str]]:
    """Parts of a text with values replaced and sentences put in."""
    if v.coin(0.25):  # as it is
        parts, at = [], 0
        for k, s, e in spans:
            parts += [("", text[at:s]), (KINDS[k], text[s:e])]
            at = e
        return [*parts, ("", text[at:])]
    parts, at = [], 0
    for k, s, e in spans:
        before = text[at:s]
        kind = KINDS[k]
        new = text[s:e]
        if v.coin(REPLACED):
            new = v.of(kind)
            if kind == "name" and ("a" <= text[e - 1] <= "z") != new.isascii():
                new = v.latin_name() if text[e - 1].isascii() else Values.name(v) if v.coin(0.1) else next(x for x in iter(v.name, None) if not x.isascii())
        parts += [("", before), (kind, new)]
        at = e
    parts.append(("", text[at:]))
    out: list[tuple[str, str]] = []
    for kind, t in parts:
        pieces = regex.split(r"(?<=[.\n])(?=\s|\S)", t) if not kind else [t]
        for x in pieces:
            out.append((kind, x))
            if not kind and x[-1:] in ".\n" and v.coin(PUT_IN / 4):
                out += [("", v.one([" ", "\n", "\n\n"])), *(v.sentence() if v.coin(0.7) else [("", v.none())]), ("", v.one([" ", "\n"]))]
    return out


class Net:
    """Parameters, loss and gradients. Both directions run at once: the second axis is the
    direction, and the backward one reads each window from its end.

    Gates are clipped lines instead of sigmoids, and the cell is kept within -1 and 1: an LSTM that
    costs less and whose memory can't run away."""

    def __init__(self, vocab: int, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        k, n = HIDDEN, len(TAGS)
        init = lambda scale, *s: (r.standard_normal(s) * scale / np.sqrt(s[-2])).astype(np.float32)
        self.p = {"emb": (r.standard_normal((vocab, EMB)) * 0.3).astype(np.float32), "w": init(0.7, 2, EMB, 4 * k), "u": init(0.5, 2, k, 4 * k), "b": np.zeros((2, 1, 4 * k), np.float32), "out": init(1.0, 2, k, n), "bias": np.zeros(n, np.float32), "trans": np.zeros((n, n), np.float32)}
        self.p["b"][:, :, : 3 * k] = 0.5
        self.p["b"][:, :, k : 2 * k] = 0.8

    def loss(self, ids: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The CRF's negative log likelihood of a batch, and its gradients. ids (time, 2, batch),
        y (time, batch); size: the windows' lengths."""
        p, k = self.p, HIDDEN
        t, _, n = ids.shape
        x = p["emb"][ids]  # t, 2, n, emb
        xw = np.matmul(x, p["w"]) + p["b"]
        g_all, c_all, h_all = np.empty((t, 2, n, 4 * k), np.float32), np.zeros((t + 1, 2, n, k), np.float32), np.zeros((t + 1, 2, n, k), np.float32)
        inside, free = np.empty((t, 2, n, 4 * k), bool), np.empty((t, 2, n, k), bool)
        low = np.zeros(4 * k, np.float32)
        low[3 * k :] = -1
        for i in range(t):
            z = xw[i] + np.matmul(h_all[i], p["u"])
            g = np.clip(z, low, 1, out=g_all[i])
            np.equal(g, z, out=inside[i])
            c = g[..., k : 2 * k] * c_all[i] + g[..., :k] * g[..., 3 * k :]
            np.clip(c, -1, 1, out=c_all[i + 1])
            np.equal(c, c_all[i + 1], out=free[i])
            h_all[i + 1] = g[..., 2 * k : 3 * k] * c_all[i + 1]
        part = np.matmul(h_all[1:], p["out"])  # t, 2, n, tags
        steps = np.arange(t)[:, None]
        turned = np.clip(size[None, :] - 1 - steps, 0, None)
        m = steps < size[None, :]
        e = part[:, 0] + np.take_along_axis(part[:, 1], turned[:, :, None], 0) + p["bias"]
        loss, de, dt = self._crf(e, y, m)
        de /= n
        dpart = np.stack([de, np.take_along_axis(de, turned[:, :, None], 0) * m[:, :, None]], 1)
        grad = {"trans": dt / n, "bias": de.sum((0, 1)), "out": np.einsum("tdnk,tdno->dko", h_all[1:], dpart, optimize=True)}
        dh_all = np.matmul(dpart, p["out"].transpose(0, 2, 1))
        dz_all = np.empty((t, 2, n, 4 * k), np.float32)
        dh, dc = np.zeros((2, n, k), np.float32), np.zeros((2, n, k), np.float32)
        ut = np.ascontiguousarray(p["u"].transpose(0, 2, 1))
        for i in range(t - 1, -1, -1):
            g, c = g_all[i], c_all[i + 1]
            a = dh_all[i] + dh
            dc = (dc + a * g[..., 2 * k : 3 * k]) * free[i]
            dz = dz_all[i]
            np.multiply(dc, g[..., 3 * k :], out=dz[..., :k])
            np.multiply(dc, c_all[i], out=dz[..., k : 2 * k])
            np.multiply(a, c, out=dz[..., 2 * k : 3 * k])
            np.multiply(dc, g[..., :k], out=dz[..., 3 * k :])
            dz *= inside[i]
            dc = dc * g[..., k : 2 * k]
            dh = np.matmul(dz, ut)
        flat = dz_all.transpose(1, 0, 2, 3).reshape(2, t * n, 4 * k)
        grad["w"] = np.matmul(x.transpose(1, 3, 0, 2).reshape(2, EMB, t * n), flat)
        grad["u"] = np.matmul(h_all[:-1].transpose(1, 3, 0, 2).reshape(2, k, t * n), flat)
        grad["b"] = flat.sum(1, keepdims=True)
        dx = np.matmul(dz_all, p["w"].transpose(0, 2, 1)).reshape(-1, EMB)
        order = np.argsort(ids.ravel(), kind="stable")
        at = ids.ravel()[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        grad["emb"] = np.zeros_like(p["emb"])
        grad["emb"][at[first]] = np.add.reduceat(dx[order], first, 0)
        return loss, grad

    def _crf(self, e: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        t, n, k = e.shape
        trans = self.p["trans"] + BARRED
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        grow = np.exp(trans)
        for i in range(1, t):
            top = alpha[i - 1].max(1, keepdims=True)
            new = top + np.log(np.exp(alpha[i - 1] - top) @ grow + 1e-30) + e[i]
            alpha[i] = np.where(m[i][:, None], new, alpha[i - 1])
        for i in range(t - 2, -1, -1):
            s = beta[i + 1] + e[i + 1]
            top = s.max(1, keepdims=True)
            new = top + np.log(np.exp(s - top) @ grow.T + 1e-30)
            beta[i] = np.where(m[i + 1][:, None], new, 0)
        top = alpha[-1].max(1)
        z = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        de = np.exp(np.minimum(alpha + beta - z[None, :, None], 0)) * m[:, :, None]
        dt = np.zeros_like(trans)
        for i in range(1, t):
            a = alpha[i - 1] - z[:, None] / 2
            b = e[i] + beta[i] - z[:, None] / 2
            ta, tb = a.max(1, keepdims=True), b.max(1, keepdims=True)
            scale = np.exp(np.minimum(ta + tb, 60)) * m[i][:, None]
            dt += (np.exp(a - ta) * scale).T @ np.exp(b - tb) * grow
        rows = np.arange(n)[None, :]
        gold = (np.take_along_axis(e, y[:, :, None], 2)[:, :, 0] * m).sum(0) + (trans[y[:-1], y[1:]] * m[1:]).sum(0)
        np.subtract.at(de, (np.arange(t)[:, None].repeat(n, 1)[m], rows.repeat(t, 0)[m], y[m]), 1)
        np.subtract.at(dt, (y[:-1][m[1:]], y[1:][m[1:]]), 1)
        return float((z - gold).mean()), de, dt


def load(d: str, rng: np.random.Generator, texts: int = TEXTS) -> tuple[list[str], list[str]]:
    """A bounded sample of texts, and the reporters' column."""
    import pyarrow.parquet as pq

    r = pq.read_table(f"{d}/reports.parquet", columns=["content", "reporter_contact"])
    a = pq.read_table(f"{d}/articles.parquet", columns=["content", "reporter"])
    pools = [(a["content"], texts // 2), (r["content"], texts // 3), (r["reporter_contact"], texts // 6)]
    got = []
    for col, n in pools:
        have = [x for x in col.to_pylist() if x]
        got += [have[i] for i in rng.permutation(len(have))[:n]]
    return got, a["reporter"].to_pylist()


class Batches:
    """Windows for training, made anew each time."""

    def __init__(self, texts: list[str], names: regex.Pattern, chars: np.ndarray) -> None:
        self.texts = [(t, guessed(t, names)) for t in texts]
        self.ids = np.fromiter((char_class(c) for c in range(0x10000)), np.int32, 0x10000)
        self.kinds = self.ids.copy()
        self.ids[chars] = np.arange(len(chars), dtype=np.int32) + CLASSES
        # every syllable once, and as many as are met in the texts
        self.syllables = "".join(chr(c) for c in chars if 0xAC00 <= c <= 0xD7A3)
        self.syllables += "".join(c for c in "".join(t[:20] for t in texts[:300]) if "가" <= c <= "힣")

    def windows(self, rng: np.random.Generator, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = Values(rng, self.syllables)
        got: list[tuple[str, np.ndarray]] = []
        while len(got) < n:
            x = rng.random()
            if x < 0.06:
                t, y = tagged(v.contact())
            elif x < 0.14:
                t, y = tagged([p for _ in range(int(rng.integers(1, 5))) for p in [*(v.sentence() if v.coin(0.75) else [("", v.none())]), ("", v.one([" ", "\n", "  "]))]])
            else:
                text, spans = self.texts[int(rng.integers(len(self.texts)))]
                if len(text) < WINDOW // 2 and not v.coin(0.4):
                    continue
                t, y = tagged(varied(text, spans, v))
            if len(t) > WINDOW:
                s = 0 if v.coin(0.25) else int(rng.integers(len(t) - WINDOW // 2))
                t, y = t[s : s + WINDOW], y[s : s + WINDOW].copy()
                if y[0] and y[0] % 2 == 0:  # a cut span still begins
                    y[0] -= 1
            if t:
                got.append((t, y))
        size = np.asarray([len(t) for t, _ in got])
        ids, tags = np.zeros((size.max(), 2, n), np.int32), np.zeros((size.max(), n), np.int64)
        for k, (t, y) in enumerate(got):
            p = folded(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
            p = np.where(p < 0x10000, p, 0xFFFF)
            c = np.where((rng.random(len(p)) < UNKNOWN) & (p >= 0xAC00), self.kinds[p], self.ids[p])
            ids[: len(c), 0, k], ids[: len(c), 1, k], tags[: len(c), k] = c, c[::-1], y
        return ids, tags, size


def main(d: str, out: str, steps: int = 1500, workers: int = 8, start: str = "", batch: int = 40) -> None:
    import multiprocessing as mp

    rng = np.random.default_rng(11)
    texts, reporters = load(d, rng)
    given = given_names(reporters, texts)
    names = regex.compile(rf"(?<![가-힣])[{forms.FAMILY_COMMON}]\s?(?:{'|'.join(sorted(given))})")
    count = Counter(c for t in texts for c in folded(np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64)).tolist())
    chars = np.asarray(sorted(c for c, _ in count.most_common(CHARS) if c < 0x10000), np.int64)
    order = rng.permutation(len(texts))
    held = [texts[i] for i in order[:VALID]]
    data = Batches([texts[i] for i in order[VALID:]], names, chars)
    net = Net(len(chars) + CLASSES)
    if start:
        with np.load(start) as w:
            for name, a in net.p.items():
                a[:] = w[name].reshape(a.shape)
    at, total = {}, 0
    for name, a in net.p.items():
        at[name] = (total, a.shape)
        total += a.size
    fork = mp.get_context("fork")
    shared = np.frombuffer(fork.RawArray("f", total), np.float32)
    grads = np.frombuffer(fork.RawArray("f", workers * (total + 1)), np.float32).reshape(workers, total + 1)
    for name, (o, shape) in at.items():
        shared[o : o + net.p[name].size] = net.p[name].ravel()
        net.p[name] = shared[o : o + net.p[name].size].reshape(shape)
    go, done = fork.Barrier(workers + 1), fork.Barrier(workers + 1)

    def work(w: int) -> None:
        own = np.random.default_rng([1000 + w, bool(start)])
        for _ in range(steps):
            made = data.windows(own, batch)
            go.wait()
            loss, g = net.loss(*made)
            for name, (o, _) in at.items():
                grads[w, o : o + g[name].size] = g[name].ravel()
            grads[w, -1] = loss
            done.wait()

    procs = [fork.Process(target=work, args=(w,), daemon=True) for w in range(workers)]
    for p in procs:
        p.start()
    m, v, kept = np.zeros(total, np.float32), np.zeros(total, np.float32), shared.copy()

    def save() -> None:
        have = {name: kept[o : o + int(np.prod(shape))].reshape(shape) for name, (o, shape) in at.items()}
        np.savez_compressed(out, chars=chars, **{k: x.astype(np.float16) for k, x in have.items()})

    mean = 0.0
    for step in range(1, steps + 1):
        go.wait()
        done.wait()
        g = grads[:, :-1].mean(0)
        g *= min(1.0, 5.0 / max(float(np.sqrt((g * g).sum())), 1e-9))
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        lr = RATE * min(1.0, step / 60) * (0.02 ** max(0.0, (step / steps - 0.3) / 0.7))
        shared -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        kept += (shared - kept) * (0.02 if step > 100 else 1.0)  # a running mean of the weights is kept
        mean = float(grads[:, -1].mean())
        if step % 100 == 0 or step == steps:
            save()
            print(step, round(mean, 3), flush=True)
    for p in procs:
        p.join(5)
    print(agreement(held, names, out))


def agreement(texts: list[str], names: regex.Pattern, weights: str) -> dict[str, tuple[int, int, int]]:
    """(guessed, found, both) spans by kind over whole texts."""
    from pathlib import Path

    from presswork.llm.pii import find_spans

    got = find_spans(texts, Path(weights).read_bytes())
    out = {}
    for k, kind in enumerate(KINDS):
        a = {(i, s, e) for i, t in enumerate(texts) for q, s, e in guessed(t, names) if q == k}
        b = {(i, s, e) for i, g in enumerate(got) for q, s, e in g if q == kind}
        out[kind] = (len(a), len(b), len(a & b))
    return out


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *(int(x) for x in sys.argv[3:5]), *sys.argv[5:6])
