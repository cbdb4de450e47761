"""Problem 6: token ids of every text, by a bounded-lookahead streaming transducer.

Text goes in piece by piece and ids come out as soon as no later text can change them.

* The pre-token pattern of the vocabulary looks at most ``PATTERN_AHEAD`` characters past a
  match, so a match that ends that far before the end of the buffer is final.
* Within a pre-token the merge list is run as a transducer over bytes. For every prefix, the last
  token of the prefix's encoding is the longest token ending there that stays separate from the
  token before it (a pair is *separate* when the merge list encodes the two tokens' bytes to just
  these two). The encoding of a prefix is the chain of those last tokens. A later byte can only
  start from one of the last ``max_len`` positions, so a token is stable once the chains of all
  these positions share it. The merge list's sufficient lookahead (no token further back can
  change) is at most merges x longest token; the chains nearly always meet within a few tokens.
* Memory: the buffer, the last ``max_len`` positions and the tokens that aren't stable yet; it
  doesn't grow with the text.

Ids for null and empty texts: the empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: the pre-token pattern that byte_bpe_50k is defined with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Finds the same pieces, quicker: common classes first, and no way back into a run.
QUICK = r" ?+(?:\p{L}++|\p{N}++)|'(?:[stmd]|re|ve|ll)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: The pattern reads at most this many characters past the end of a match ('re after ').
PATTERN_AHEAD = 3
#: A pre-token beyond this many characters is fed to the transducer in parts.
LONG = 2048
#: Distinct pre-tokens of which a worker keeps the ids.
CACHED = 400_000


def default_vocabulary() -> str:
    """Path of byte_bpe_50k in the installed public tokenizers; a parameter everywhere else."""
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Merges:
    """A merge list: ranks of byte strings, and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.max_len = max(map(len, ranks))
        self.lookahead = sum(len(t) > 1 for t in ranks) * self.max_len
        self._separate: dict[tuple[bytes, bytes], bool] = {}
        self._final: dict[int, str] = {}

    def whole(self, data: bytes) -> list[bytes]:
        """The merge list applied to a short byte string: the best-ranked pair first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def separate(self, a: bytes, b: bytes) -> bool:
        """Whether ``a`` followed by ``b`` is encoded as just these two tokens."""
        k = (a, b)
        known = self._separate.get(k)
        if known is None:
            if len(self._separate) > 2_000_000:
                self._separate.clear()
            known = self._separate[k] = self.whole(a + b) == [a, b]
        return known


@lru_cache(maxsize=4)
def load_merges(path: str) -> Merges:
    """Read a .tiktoken file (token in base64 and its rank on each line)."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})


class Transducer:
    """Bytes of one pre-token in, stable token ids out."""

    def __init__(self, merges: Merges) -> None:
        self.m = merges
        self.tail = b""  #: the last max_len bytes before the position reached
        self.at = 0  #: bytes read
        self.last: dict[int, bytes | None] = {0: None}  #: position -> last token of that prefix
        self.done = 0  #: bytes whose tokens were emitted

    def feed(self, data: bytes, check_every: int = 256) -> list[int]:
        m, out = self.m, []
        ranks, longest, last, separate = m.ranks, m.max_len, self.last, m._separate
        for i in range(len(data)):
            self.tail = tail = (self.tail + data[i : i + 1])[-longest:]
            self.at = at = self.at + 1
            for n in range(min(len(tail), at - self.done), 0, -1):
                t = tail[-n:]
                if t not in ranks:
                    continue
                start = at - n
                if start not in last:
                    continue
                before = last[start]
                if before is None:
                    last[at] = t
                    break
                known = separate.get((before, t))
                if known is None:
                    known = m.separate(before, t)
                if known:
                    last[at] = t
                    break
            if at % check_every == 0:
                out += self._emit()
        return out

    def _chain(self, at: int) -> list[tuple[int, bytes]]:
        got = []
        while at > self.done:
            t = self.last[at]
            got.append((at, t))
            at -= len(t)
        return got[::-1]

    def _emit(self) -> list[int]:
        """Tokens that the chains of all positions a later byte can start from share."""
        starts = [p for p in range(max(self.done, self.at - self.m.max_len + 1), self.at + 1) if p in self.last]
        if starts[0] == self.done:
            return []
        common = self._chain(starts[0])
        for p in starts[1:]:
            chain, k = self._chain(p), 0
            while k < len(common) and k < len(chain) and common[k] == chain[k]:
                k += 1
            common = common[:k]
            if not common:
                return []
        self.done = end = common[-1][0]
        for p in [p for p in self.last if p < end]:
            del self.last[p]
        return [self.m.ranks[t] for _, t in common]

    def finish(self) -> list[int]:
        out = [self.m.ranks[t] for _, t in self._chain(self.at)]
        self.__init__(self.m)
        return out


class _Ids(dict):
    """Pre-token -> ids as int32 bytes; runs the transducer for one that isn't there."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.m = merges

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        r = self.m.ranks.get(data)
        if r is not None:
            got = [r]
        else:
            t = Transducer(self.m)
            got = t.feed(data)
            got += t.finish()
        v = np.asarray(got, np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = v
        return v


class StreamingEncoder:
    """``feed`` text in parts of any size, then ``finish``; both give int32 ids as bytes."""

    _same = {"L": regex.compile(r"\p{L}*"), "N": regex.compile(r"\p{N}*"), "P": regex.compile(r"[^\s\p{L}\p{N}]*")}

    def __init__(self, merges: Merges, ids: _Ids | None = None) -> None:
        self.m, self.ids = merges, ids if ids is not None else _Ids(merges)
        self.pattern = regex.compile(PATTERN)
        self.buf, self.inside, self.run = "", "", Transducer(merges)

    def feed(self, text: str) -> bytes:
        out = []
        if self.inside:  # a long pre-token goes on as far as its class of characters does
            n = self._same[self.inside].match(text).end()
            out.append(np.asarray(self.run.feed(text[:n].encode()), np.int32).tobytes())
            if n == len(text):
                return b"".join(out)
            out.append(np.asarray(self.run.finish(), np.int32).tobytes())
            self.inside, text = "", text[n:]
        buf = self.buf + text
        end, take, limit = 0, [], len(buf) - PATTERN_AHEAD
        for x in self.pattern.finditer(buf):
            if x.end() > limit:
                break
            take.append(x.group())
            end = x.end()
        out.append(b"".join(map(self.ids.__getitem__, take)))
        self.buf = buf = buf[end:]
        if len(buf) > LONG:
            x = self.pattern.match(buf)
            if x.end() == len(buf) and not buf[-1].isspace():
                c = buf[-1]
                self.inside = "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "P"
                out.append(np.asarray(self.run.feed(buf.encode()), np.int32).tobytes())
                self.buf = ""
        return b"".join(out)

    def finish(self) -> bytes:
        if self.inside:
            self.inside = ""
            return np.asarray(self.run.finish(), np.int32).tobytes()
        out = b"".join(map(self.ids.__getitem__, self.pattern.findall(self.buf)))
        self.buf = ""
        return out


class Encoder:
    """Whole texts; long ones go through the streaming encoder in parts of ``part`` characters."""

    def __init__(self, merges: Merges, part: int = 1 << 16) -> None:
        self.m, self.part, self.ids = merges, part, _Ids(merges)
        self.find = regex.compile(QUICK).findall

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(text) <= self.part:
            pieces = self.find(text)
            if max(map(len, pieces)) <= LONG:
                return b"".join(map(self.ids.__getitem__, pieces))
        s = StreamingEncoder(self.m, self.ids)
        out = [s.feed(text[i : i + self.part]) for i in range(0, len(text), self.part)]
        return b"".join(out) + s.finish()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder in each worker process."""
    return Encoder(load_merges(path))


class TextDecoder:
    """Byte-to-text state machine: token ids in, text out as soon as its bytes are complete.

    The state is the bytes of a character begun and how many are still to come. Bytes that can't
    be UTF-8 come out as U+FFFD."""

    def __init__(self, merges: Merges) -> None:
        self.m, self.state = merges, b""

    def _need(self, lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1

    def feed(self, ids: Iterable[int]) -> str:
        data = self.state + b"".join(map(self.m.text.__getitem__, ids))
        end = len(data)
        for back in range(1, min(4, end) + 1):  # a character begun within the last 3 bytes
            b = data[-back]
            if b & 0xC0 != 0x80:
                if self._need(b) > back:
                    end -= back
                break
        self.state = data[end:]
        return data[:end].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.state = self.state.decode("utf-8", "replace"), b""
        return out


def encode_batches(batches: Iterator, path: str) -> Iterator:
    """(doc_id, text) record batches -> (doc_id, ids)."""
    import pyarrow as pa

    e = encoder(path)
    for b in batches:
        texts = b.column(1).to_pylist()
        got = [e.encode(t) for t in texts]
        offsets = np.zeros(len(got) + 1, np.int32)
        np.cumsum([len(g) >> 2 for g in got], out=offsets[1:])
        values = pa.array(np.frombuffer(b"".join(got), np.int32))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "ids"])


def count_batches(batches: Iterator, path: str) -> Iterator:
    """(doc_id, text) record batches -> (doc_id, n_tokens)."""
    import pyarrow as pa

    e = encoder(path)
    for b in batches:
        n = np.asarray([len(e.encode(t)) >> 2 for t in b.column(1).to_pylist()], np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["doc_id", "n_tokens"])


def round_trip_batches(batches: Iterator, path: str) -> Iterator:
    """(doc_id, text) record batches -> (doc_id, n_tokens, same): the ids decoded in parts give the text."""
    import pyarrow as pa

    e, part = encoder(path), 1000
    for b in batches:
        texts, n, same = b.column(1).to_pylist(), [], []
        for t in texts:
            ids = np.frombuffer(e.encode(t), np.int32).tolist()
            d = TextDecoder(e.m)
            back = "".join(d.feed(ids[i : i + part]) for i in range(0, len(ids), part)) + d.finish()
            n.append(len(ids))
            same.append(back == (t or ""))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "same"])
