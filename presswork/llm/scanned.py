"""Problem 5: noise of scanned pages, by a noisy channel over words.

* Counts of all words and of all three-character pieces of the corpus are kept in a sketch (two
  hashed rows, the smaller count holds) that grows with their number up to GREATEST. A word's
  likelihood is that of its count, with a share for that of its pieces, so that words the corpus
  hasn't got whole are weighed too.
* How a syllable or letter is misprinted is learned from the corpus: rare words that are a frequent
  one but for one or two characters, where the misprint befalls all words with those characters
  alike (``likely_pairs``). Shape tables below say what is possible besides: look-alike parts,
  blots, stray marks.
* A line is decoded by Viterbi over candidate words: channel times likelihood of the word and of
  its ending after the ending before. A line is misread where the best words aren't the printed ones.
* Running heads, page numbers and broken words are told by their form and the corpus's words.

Positions are kept: every line of the input is looked at, whatever its text's length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.session import spread, stage

#: Counters in a row of the sketch, at most and at least.
GREATEST, LEAST = 1 << 23, 1 << 16
#: Share of a word's likelihood that comes from its pieces.
BY_PIECES = 0.02
#: Share of characters that are misread, before the corpus says more.
NOISE = 0.003
#: Tokens of more characters are read as words without spaces, each of at most JOINED characters.
LONG, JOINED = 40, 12
#: Share of the words that should show a misprint and do, at least.
ALIKE = 0.3
#: Counts below SEEN + 1 aren't kept: so rare a word is no evidence for itself.
SEEN = 2
#: Words met more often aren't read as holding two misprints.
TWICE = 10
#: Log odds: of another word than the printed one, and of one more character of an unknown word.
MARGIN, UNKNOWN = 4, 7

# Signs that stand for a character that couldn't be read.
BLOTS = "□■¿�"
# Marks that break a word at the end of a line.
BREAKS = "-‐‑–¬­"
# What initials and vowels of Hangul are taken for.
INITIAL_SHAPES = {"ㄱ": "ㄱ7", "ㄴ": "ㄴL", "ㄷ": "ㄷC", "ㄹ": "ㄹ2", "ㅁ": "ㅁ口o", "ㅂ": "ㅂ", "ㅅ": "ㅅ人^", "ㅇ": "ㅇ0oO", "ㅈ": "ㅈX", "ㅊ": "ㅊ", "ㅋ": "ㅋ", "ㅌ": "ㅌE", "ㅍ": "ㅍ", "ㅎ": "ㅎ"}
VOWEL_SHAPES = {"ㅏ": ["ㅏ", "r", "F"], "ㅓ": ["ㅓ", "-l"], "ㅣ": ["ㅣ", "l", "I", "|", "1"], "ㅗ": ["ㅗ"], "ㅜ": ["ㅜ", "T"], "ㅡ": ["ㅡ", "—", "_"], "ㅐ": ["ㅐ", "H"], "ㅔ": ["ㅔ"], "ㅑ": ["ㅑ"], "ㅕ": ["ㅕ"], "ㅛ": ["ㅛ"], "ㅠ": ["ㅠ"]}
# Letters that digits are taken for.
DIGIT_SHAPES = "lIOoZSBbgq"
# What Latin letters are taken for.
LATIN_SHAPES = {"0": "o l i s b g z q", "I": "l", "|": "l", "rn": "m", "ii": "u", "vv": "w", "c": "e o", "e": "c", "h": "b li", "b": "h", "cl": "d", "li": "h", "nn": "m", "m": "rn nn", "u": "ii", "l": "i", "i": "l", "€": "e", "@": "a", "o": "c", "n": "u ti ri", "d": "cl", "w": "vv", "t": "f", "f": "t", "ri": "n"}

_INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
_VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
#: Written pair -> syllables it may stand for, from the shapes.
PAIRS: dict[str, str] = {}
for _a, _shapes in INITIAL_SHAPES.items():
    for _b, _vs in VOWEL_SHAPES.items():
        for _p in (i + v for i in _shapes for v in _vs):
            PAIRS[_p] = PAIRS.get(_p, "") + chr(0xAC00 + (_INITIALS.index(_a) * 21 + _VOWELS.index(_b)) * 28)
#: A syllable whose vowel lost its second stroke: 호l for 회.
PAIRS["5ㄷ"] = "도"
LOST = {("ㅗ", "ㅣ"): "ㅚ", ("ㅜ", "ㅣ"): "ㅟ", ("ㅡ", "ㅣ"): "ㅢ", ("ㅗ", "ㅏ"): "ㅘ", ("ㅏ", "ㅣ"): "ㅐ", ("ㅓ", "ㅣ"): "ㅔ"}

_STRIP_L = "\"“‘'([<〈「『*※▶■●○ⓒ-–|="
_STRIP_R = "\"”’')]>〉」』.,!?;:|…"
_TWO = "|".join(sorted(regex.escape(p) for p in PAIRS if not p[1].isdigit()))
#: Parts of syllables between syllables: misread whether or not the corpus knows the word.
_JAMO = regex.compile(rf"[가-힣][ㄱ-ㅎㅏ-ㅣ人]|[ㄱ-ㅎㅏ-ㅣ人][가-힣]|(?<![A-Za-z0-9])(?:{_TWO})(?=[가-힣])|(?<=[가-힣])(?:{_TWO})(?![A-Za-z0-9])|[호으][lI](?![A-Za-z])|(?<=[가-힣])[|](?=[가-힣])")
#: Digits, but for those that stand for part of a syllable.
_DIGIT = regex.compile(r"[0-9](?![lrIF|ㅏㅓㅣㅐHㄷ—])")
_NUMBER = re.compile(rf"(?<![A-Za-z가-힣])[0-9{DIGIT_SHAPES}][0-9{DIGIT_SHAPES}.,]*(?=[가-힣%]|$)")
_SHAPES = re.compile(f"[0-9{DIGIT_SHAPES}]")
_ADDRESS = re.compile(r"@|＠|\.(?:example|test|invalid|com|net|org|kr)\b|://|골뱅이", re.I)
#: Tokens of syllables only hold no parts of syllables, and those without a digit no number.
_SYLLABLES = re.compile("[가-힣]+")
#: Letters of one script beside signs of another or a digit; and a digit that isn't among letters.
_PART = re.compile(r"[A-Za-zㄱ-ㅎㅏ-ㅣ人口^|—_-]")
_MIXED = re.compile(r"[A-Za-z][0-9|]|[0-9|][A-Za-z]|[가-힣][A-Za-zㄱ-ㅎㅏ-ㅣ人口^|—]|[A-Za-zㄱ-ㅎㅏ-ㅣ人口^|—][가-힣]")
_LOOSE_DIGIT = re.compile(r"(?<![A-Za-z])[0-9]|[0-9](?![A-Za-z])")
_ANY_DIGIT = re.compile(r"\d")
_ANY_LETTER = re.compile(r"[^\W\d_]")


def _blotted(w: str) -> bool:
    """Whether a sign that couldn't be read or a part of a syllable stands in a word."""
    if w.isascii():
        return False
    return "¿" in w or "�" in w or (len(w) > 1 and ("□" in w or "■" in w)) or bool(_PART.search(w) and _JAMO.search(w))


def bare(token: str) -> str:
    """A token without punctuation around it and with its digits as 0."""
    t = token.lstrip(_STRIP_L).rstrip(_STRIP_R)
    if t and not t.isalpha():
        t = _DIGIT.sub("0", t)
    return t.lower() if t.isascii() else t


def slots(key: str, width: int) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass"))
    return h % width, width + (h >> 32) % width


class Counts:
    """The sketch: counts of words, of three-character pieces and of pairs of word endings."""

    def __init__(self, table: np.ndarray, total: int, learned: dict[tuple[str, str], float] | None = None) -> None:
        self.table, self.total, self.learned = table, max(total, 1), learned or {}
        self.width = len(table) // 2
        self.by_print: dict[str, list[tuple[str, float]]] = {}
        for (true, printed), p in self.learned.items():
            self.by_print.setdefault(printed, []).append((true, p))

    def n(self, key: str) -> int:
        a, b = slots(key, self.width)
        return int(min(self.table[a], self.table[b]))

    def word(self, w: str) -> int:
        return self.n("w" + w)

    def pieces(self, w: str, own: int = 0) -> float:
        """Log likelihood of a word by its three-character pieces, without its ``own`` occurrences."""
        s = "^" + w + "$"
        got = 0.0
        for i in range(len(s) - 2):
            whole, part = self.n("t" + s[i : i + 3]) - own, self.n("p" + s[i : i + 2]) - own
            got += math.log((max(whole, 0) + 0.01) / (max(part, 0) + 2.0))
        return got

    def unseen(self, w: str, own: int = 0) -> float:
        """Log likelihood of a word by its pieces alone."""
        return math.log(BY_PIECES) + self.pieces(w, own)


class Tally:
    """Words and pairs of word endings of texts, counted across batches."""

    def __init__(self) -> None:
        self.words: Counter = Counter()
        self.ends: Counter = Counter()
        self.cache: dict[str, str] = {}

    def _bare(self, x: str) -> str:
        w = self.cache.get(x)
        if w is None:
            if len(self.cache) > 1_000_000:
                self.cache.clear()
            w = self.cache[x] = "" if _ADDRESS.search(x) else bare(x)
        return w

    def add(self, texts: list[str | None]) -> None:
        for t in texts:
            if t:
                got = list(map(self._bare, t.split()))
                self.words.update(got)
                last = [w[-1:] for w in got]
                self.ends.update(zip(last, last[1:]))

    def keys(self) -> Counter:
        """Counts of words, of their pieces, of ending pairs, and of all words (#)."""
        self.words.pop("", None)
        out: Counter = Counter()
        for w, n in self.words.items():
            out["w" + w] += n
            s = "^" + w + "$"
            for i in range(len(s) - 2):
                out["t" + s[i : i + 3]] += n
                out["p" + s[i : i + 2]] += n
        for (a, b), n in self.ends.items():
            out["e" + a + b] += n
            out["f" + a] += n
        out["#"] = sum(self.words.values())
        self.words.clear(), self.ends.clear()
        return out


def frequent_and_rare(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words`` (w, n) -> (true, bucket, words, n) of the frequent words' pieces of one and two
    characters, and (true, printed, n, words) of rare words that are a frequent one, at least 20
    times as frequent and more, but for such a piece. A rare word counts for the closest frequent
    one only. Words of 2 to 12 characters that aren't broken at a line's end."""
    marks = "".join(f"\\u{ord(x):04x}" for x in BREAKS)
    words = words.filter(F.length("w").between(2, 12) & ~F.col("w").rlike(f"[{marks}]$"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.array(F.struct(i.alias("at"), F.lit(1).alias("size")), F.struct(i.alias("at"), F.lit(2).alias("size")))))
    cut = words.withColumn("x", F.explode(cuts)).filter("x.at + x.size - 1 <= length(w) and length(w) > x.size")
    cut = cut.select("w", "n", F.expr("concat(substring(w, 1, x.at - 1), chr(1), substring(w, x.at + x.size))").alias("rest"), F.expr("substring(w, x.at, x.size)").alias("piece"))
    frequent = cut.filter(F.col("n") >= 40).select("rest", F.col("piece").alias("true"), F.col("n").alias("big"))
    sizes = frequent.groupBy("true", F.floor(F.log2("big")).cast("int").alias("bucket")).agg(F.count("*").alias("words"), F.sum("big").alias("n"))
    x, y = F.ascii("true") - 0xAC00, F.ascii("printed") - 0xAC00
    same = [(F.floor(x / 588) == F.floor(y / 588)), (F.floor(x / 28) % 21 == F.floor(y / 28) % 21), (x % 28 == y % 28)]
    syllables = F.col("true").rlike("^[가-힣]+$") & F.col("printed").rlike("^[가-힣]+$")
    sizes_of = F.length("true") + F.length("printed")
    # of two syllables two of initial, vowel and final are equal; a piece isn't just longer or
    # shorter by a letter, nor one of two characters of which one is equal
    alike = ~syllables | ((sizes_of == 2) & (sum(c.cast("int") for c in same) >= 2))
    rest = F.when(F.length("true") > F.length("printed"), F.expr("replace(`true`, printed, '')")).otherwise(F.expr("replace(printed, `true`, '')"))
    longer = (sizes_of == 3) & (F.length(rest) == 1) & rest.rlike(r"^[\p{L}\p{N}]$")
    halves = (sizes_of == 4) & ((F.substring("true", 1, 1) == F.substring("printed", 1, 1)) | (F.substring("true", 2, 1) == F.substring("printed", 2, 1)))
    apart = (F.col("true") != F.col("printed")) & alike & ~longer & ~halves
    met = frequent.join(cut.select("rest", F.col("piece").alias("printed"), "w", "n"), "rest").filter("big >= 20 * n + 20").filter(apart)
    closest = F.max(F.struct(-F.length(F.concat("true", "printed")), "big", "true", "printed")).alias("x")
    one = met.groupBy("w", "n").agg(closest)
    return sizes, one.groupBy("x.true", "x.printed").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


def likely_pairs(sizes: list[tuple[str, int, int, int]], pairs: list[tuple[str, str, int, int]]) -> dict[tuple[str, str], float]:
    """Chance of each misprint (true, printed). A pair counts if it is met in at least five words,
    not more often than a misprint can be, and in as many words as it should be met in if it befell
    all words with those characters alike; another word or ending befalls a few."""
    of: dict[str, list[tuple[int, int, int]]] = {}
    for true, *x in sizes:
        of.setdefault(true, []).append(tuple(x))
    got = {}
    for true, printed, n, words in pairs:
        have = of.get(true, [])
        p = n / max(sum(x[2] for x in have), 1)
        if words >= 5 and 1e-4 <= p <= 0.05:
            expected = sum(k * (1 - (1 - p) ** (total / k)) for _, k, total in have)
            if words >= ALIKE * expected:
                got[true, printed] = p
    return got


class Channel:
    """Candidates for a printed word, with their log channel probabilities."""

    def __init__(self, counts: Counts) -> None:
        self.c = counts
        self.keep = math.log(1 - NOISE)
        self.cache: dict[str, list[tuple[str, float]]] = {}
        self.syllables: list[str] | None = None

    def _hangul(self, w: str) -> list[tuple[str, float]]:
        """Printed forms undone one step each: parts put together, strays dropped, blots filled."""
        out: dict[str, float] = {}
        rare = math.log(NOISE)
        m = _NUMBER.search(w)
        if m and (_ANY_DIGIT.search(w) or not w.isascii()) and (read := _SHAPES.sub("0", m[0])) != m[0]:
            out[w[: m.start()] + read + w[m.end() :]] = rare
        for i in range(len(w)):
            two = w[i : i + 2]
            if two in PAIRS and not all("가" <= x <= "힣" for x in two):
                out |= {w[:i] + true + w[i + 2 :]: rare for true in PAIRS[two]}
            if len(two) == 2 and "가" <= two[0] <= "힣" and (ord(two[0]) - 0xAC00) % 28 == 0:
                x = ord(two[0]) - 0xAC00
                vowel = _VOWELS[x // 28 % 21]
                for v, shapes in VOWEL_SHAPES.items():
                    if two[1] in shapes and (vowel, v) in LOST:
                        out[w[:i] + chr(0xAC00 + (x // 588 * 21 + _VOWELS.index(LOST[vowel, v])) * 28) + w[i + 2 :]] = rare
            if 0 < i < len(w) - 1 and not w[i].isalnum() and w[i] not in "·%.~" and w[i - 1].isalpha() and w[i + 1].isalpha():
                out[w[:i] + w[i + 1 :]] = rare
        return list(self._learned(w, out).items())

    def _learned(self, w: str, out: dict[str, float]) -> dict[str, float]:
        """``out`` and what the learned misprints lead to, the likelier where both lead to a word."""
        digits = not w.isascii()
        for i in range(len(w)):
            for size in (1, 2):
                piece = w[i : i + size]
                if digits and piece.isdigit():  # digits stand for letters among letters only
                    continue
                for true, p in self.c.by_print.get(piece, ()):
                    y, p = w[:i] + true + w[i + size :], math.log(max(p, 1e-6))
                    if out.get(y, -1e9) < p:
                        out[y] = p
        return out

    def _latin(self, w: str) -> list[tuple[str, float]]:
        out: dict[str, float] = {}
        for shape, trues in LATIN_SHAPES.items():
            at = w.find(shape)
            while at >= 0:
                out |= {w[:at] + true + w[at + len(shape) :]: math.log(NOISE / 3) for true in trues.split()}
                at = w.find(shape, at + 1)
        for i in range(1, len(w) - 1):
            if not w[i].isalnum() and w[i] not in "'’-." and w[i - 1].isalpha() and w[i + 1].isalpha():
                out[w[:i] + w[i + 1 :]] = math.log(NOISE / 3)
        if not w.isalpha():  # a number, or a syllable in parts beside one
            out |= dict(self._hangul(w))
        return list(self._learned(w, out).items())

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """(word, channel + word score) of what may have been printed, the word itself first.

        Two misprints in one word are undone one after the other, where one alone doesn't lead to a
        known word. Of a word with signs that words aren't made of, that leads to none either way,
        the readings are weighed by their pieces."""
        known = self.cache.get(w)
        if known is not None:
            return known
        c = self.c
        steps = self._latin if w.isascii() else self._hangul
        own = c.word(w)
        have = {y: p for y, p in steps(w) if y and y != w}
        met = [(y, p, n) for y, p in have.items() if (n := c.word(y))]
        if own <= TWICE and not any(n > SEEN for *_, n in met):
            twice: dict[str, float] = {}
            for x, p in have.items():
                for y, q in steps(x):
                    if y and y != w and y not in have and twice.get(y, -1e9) < p + q:
                        twice[y] = p + q
            have |= twice
            met += [(y, p, n) for y, p in twice.items() if (n := c.word(y))]
        # what the misprints of the candidates explain isn't evidence for the printed word
        explained = sum(n * math.exp(p) for _, p, n in met)
        got = [(w, self.keep + math.log(max(own - 3 * explained - SEEN, 0.02) / c.total))]
        got += [(y, p + math.log(n / c.total)) for y, p, n in met if n > SEEN]
        if len(got) == 1 and own <= SEEN and have and _MIXED.search(w) and not _LOOSE_DIGIT.search(w):
            got = [(w, self.keep + c.unseen(w, own))] + [(y, p + c.unseen(y)) for y, p in have.items() if y.isalpha() and len(y) > 1]
        got = [got[0], *sorted(got[1:], key=lambda x: -x[1])]
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[w] = got
        return got


    def joined(self, w: str) -> str:
        """The likeliest reading of words without spaces between them: Viterbi over the places where
        words may part. What the corpus doesn't know costs by its length, and another word than the
        printed one must be likelier by the margin that a single word needs."""
        best: list[tuple[float, int, str]] = [(0.0, 0, "")]
        for i in range(1, len(w) + 1):
            top = (-math.inf, 0, "")
            for j in range(max(0, i - JOINED), i):
                part = w[j:i]
                (_, own), *rest = self.candidates(part)
                if not self.c.word(part):
                    own -= UNKNOWN * (len(part) - 1)
                read, p = part, own
                for x, q in rest:
                    if q - MARGIN > p:
                        read, p = x, q - MARGIN
                if best[j][0] + p > top[0]:
                    top = (best[j][0] + p, j, read)
            best.append(top)
        got, i = [], len(w)
        while i:
            _, j, read = best[i]
            got.append(read)
            i = j
        return "".join(got[::-1])


class Reader:
    """Kinds of noise in the lines of a text."""

    def __init__(self, counts: Counts, papers: list[str]) -> None:
        self.c, self.channel = counts, Channel(counts)
        names = "|".join(regex.escape(p) for p in sorted(papers, key=len, reverse=True)) or r"(?!)"
        self.name = regex.compile(names)
        self.plain: dict[str, bool] = {}

    # what a running head is made of besides the paper's name
    _dated = regex.compile(r"제\s*\S{1,6}\s*호|\S{4}\s*년\s*\S{1,3}\s*월\s*\S{1,3}\s*일|\S\s?요일")
    _head = [
        regex.compile(r"\S+\s+제\s*[0-9０-９OolI]+\s*호\s+[0-9０-９OolI]{4}\s*년\s+[0-9０-９OolI]{1,2}\s*월\s+[0-9０-９OolI]{1,2}\s*일\s+\S\s?요일"),
        regex.compile(r"[0-9０-９OolI]{4}\s?\.\s?[0-9０-９OolI]{1,2}\s?\.\s?[0-9０-９OolI]{1,2}\.?\s*[(（]\s*\S{2,12}\s*[)）]\s*[0-9０-９OolI]{1,3}"),
        regex.compile(r"\S{2,12}\s*[|│]\s*[0-9０-９OolI]{1,3}\s*면\s*[|│]?\s*\S{1,8}"),
    ]
    _page = regex.compile(r"(?:[-–—·•|〈<\[(]\s*)?[0-9０-９]{1,4}(?:\s*[-–—·•|〉>\])])?|[Pp]age\s+[0-9]{1,4}(?:\s+of\s+[0-9]{1,4})?|[Pp]\.?\s?[0-9]{1,4}|(?:제\s*)?[0-9０-９]{1,4}\s*(?:면|쪽)|[-–]\s*[0-9]{1,4}\s*(?:면|쪽)\s*[-–]|[0-9]{1,3}\s*/\s*[0-9]{1,3}")
    _stuck = regex.compile(r"^\s*[0-9０-９]{1,3}\s+\S.*|.*\S\s+[0-9０-９]{1,3}\s*$", regex.S)

    def is_header(self, line: str) -> bool:
        """A paper's name with issue, date or page, and at most a section's name besides."""
        s = line.strip()
        if not s or not _ANY_DIGIT.search(s):
            return False
        core = s.strip("<>|·*※▶■-– ")
        if any(p.fullmatch(core) for p in self._head):
            return True
        m = self.name.search(core)
        if not m or regex.search(r"[0-9]{2,4}\s?[-)]\s?[0-9]{3,4}\s?-\s?[0-9]{4}|@", core):
            return False
        rest = self._dated.sub(" ", core[: m.start()] + " " + core[m.end() :])
        words = regex.findall(r"\p{L}+", regex.sub(r"[0-9]+\s*(?:면|쪽|호)?", " ", rest))
        return len(words) <= 1 and sum(map(len, words)) <= 6

    def is_page_number(self, line: str) -> bool:
        s = line.strip()
        return bool(s) and bool(self._page.fullmatch(s)) and not regex.fullmatch("(?:19|20)[0-9]{2}", s)

    def is_broken(self, line: str, below: str | None) -> bool:
        """The last word ends in a break mark and its rest stands below."""
        s = line.rstrip()
        if below is None or len(s) < 2 or s[-1] not in BREAKS or not s[-2].isalpha():
            return False
        rest = below.lstrip()
        if not rest or not rest[0].isalpha():
            return False
        if s[-1] == "-":  # a word that has its hyphen anyway isn't broken
            a, b = s[:-1].split()[-1], regex.split(r"\s", rest)[0]
            if self.c.word(bare(a + "-" + b)) > 3 * self.c.word(bare(a + b)):
                return False
        return True

    def _is_plain(self, token: str) -> bool:
        """Whether a token needs no decoding: no letters, an address, or a word with nothing likelier."""
        known = self.plain.get(token)
        if known is None:
            if len(self.plain) > 1_000_000:
                self.plain.clear()
            w = "" if _ADDRESS.search(token) else bare(token)
            if not _SYLLABLES.fullmatch(w) and _blotted(w):
                known = False
            elif not _ANY_LETTER.search(w):
                known = True
            elif len(w) > LONG:
                known = self.channel.joined(w) == w
            else:
                got = self.channel.candidates(w)
                known = len(got) == 1 or got[0][1] >= max(p for _, p in got[1:]) + MARGIN
            self.plain[token] = known
        return known

    def decode(self, tokens: list[str]) -> list[str]:
        """Viterbi over the candidates of each word; blots are told without the corpus."""
        words = [bare(t) for t in tokens]
        layers = [[(w, 0.0)] if self._is_plain(t) else [(self.channel.joined(w), 0.0)] if len(w) > LONG else self.channel.candidates(w) for t, w in zip(tokens, words)]
        best = [p for _, p in layers[0]]
        back: list[list[int]] = []
        for a, b in zip(layers, layers[1:]):
            row, ptr = [], []
            for w, p in b:
                if len(a) == 1 and len(b) == 1:
                    row.append(best[0] + p)
                    ptr.append(0)
                    continue
                sc = [best[k] + 0.5 * math.log((self.c.n("e" + x[-1:] + w[-1:]) + 0.5) / (self.c.n("f" + x[-1:]) + 50.0)) for k, (x, _) in enumerate(a)]
                k = max(range(len(sc)), key=sc.__getitem__)
                row.append(sc[k] + p)
                ptr.append(k)
            best = row
            back.append(ptr)
        k = max(range(len(best)), key=best.__getitem__)
        path = [k]
        for ptr in reversed(back):
            k = ptr[k]
            path.append(k)
        return [layer[k][0] for layer, k in zip(layers, path[::-1])]

    def _misread_tokens(self, tokens: list[str]) -> list[tuple[int, str]]:
        """(token, what it should read) of the tokens that were misread."""
        if not tokens or all(map(self._is_plain, tokens)):
            return []
        got = []
        for i, (t, w) in enumerate(zip(tokens, self.decode(tokens))):
            b = bare(t)
            if w != b or _blotted(b) or (i and t in "□■"):
                got.append((i, w))
        return got

    def kinds(self, text: str) -> list[tuple[int, str]]:
        """(line number from 1, kind) of a text's lines."""
        lines = text.split("\n")
        out: list[tuple[int, str]] = []
        carry = ""  # a word's beginning, broken at the end of the line above
        for n, line in enumerate(lines):
            s = line.strip()
            if not s:
                continue
            head = self.is_header(line)
            if head:
                out.append((n + 1, "header"))
            elif self.is_page_number(line):
                out.append((n + 1, "page_no"))
                continue
            below = None
            if s[-1] in BREAKS:
                below = next((x for x in lines[n + 1 :] if x.strip() and not self.is_header(x) and not self.is_page_number(x) and not _FURNITURE.fullmatch(x.strip())), None)
            broken = not head and self.is_broken(line, below)
            if broken:
                out.append((n + 1, "hyphen"))
            tokens = s.split()
            if carry and not head and not _FURNITURE.fullmatch(s):
                whole = carry + tokens[0]
                bad = self._misread_tokens([whole])
                # a misprint in the joined word counts for the line its character stands in
                if bad and not self._begins_badly(carry, bad[0][1], whole):
                    out.append((n + 1, "misread"))
                tokens = tokens[1:]
                carry = ""
            if broken:
                begin = tokens.pop().rstrip(BREAKS) if tokens else ""
                rest = below.split()[0]
                bad = self._misread_tokens([begin + rest])
                if bad and self._begins_badly(begin, bad[0][1], begin + rest):
                    out.append((n + 1, "misread"))
                carry = begin
            if (n + 1, "misread") not in out[-4:] and self._misread_tokens(tokens):
                out.append((n + 1, "misread"))
        return out

    @staticmethod
    def _begins_badly(begin: str, true: str, whole: str) -> bool:
        """Whether the printed word first differs from the true one within ``begin``."""
        if any(b in begin for b in BLOTS):
            return True
        a = begin.lstrip(_STRIP_L)
        a = a.lower() if whole.isascii() else a
        return not true.startswith(regex.sub("[0-9]", "0", a))

    def title_kinds(self, title: str) -> list[tuple[int, str]]:
        out: list[tuple[int, str]] = []
        for n, line in enumerate(title.split("\n")):
            if not line.strip():
                continue
            if self.is_header(line):
                out.append((n + 1, "header"))
            elif self.is_page_number(line) or self._stuck.fullmatch(line):
                out.append((n + 1, "page_no"))
            if self._misread_tokens(line.split()):
                out.append((n + 1, "misread"))
        return out

    def repaired(self, text: str) -> str:
        """Continuous paragraphs: no heads, page numbers or broken words, likeliest words, hard line
        ends undone. Empty lines and lines that end a sentence before an indented one part paragraphs."""
        paragraphs: list[str] = []
        cur = ""
        for line in text.split("\n"):
            s = line.strip()
            if not s:
                if cur:
                    paragraphs.append(cur)
                    cur = ""
                continue
            if self.is_header(line) or self.is_page_number(line):
                continue
            if line[:1] in " \t" and cur and cur[-1] in ".?!\"”":
                paragraphs.append(cur)
                cur = ""
            if cur and cur[-1] in BREAKS and len(cur) > 1 and cur[-2].isalpha() and s[0].isalpha():
                cur = cur[:-1] + s if self.is_broken(cur, s) else cur + s
            else:
                cur = f"{cur} {s}" if cur else s
        if cur:
            paragraphs.append(cur)
        return "\n".join(self._corrected(p) for p in paragraphs)

    def _corrected(self, line: str) -> str:
        tokens = line.split()
        for i, w in self._misread_tokens(tokens):
            b = bare(tokens[i])
            at = tokens[i].lower().find(b) if b.isascii() else tokens[i].find(b)
            if b and w != b and at >= 0 and not any(x.isdigit() for x in b):
                tokens[i] = tokens[i][:at] + w + tokens[i][at + len(b) :]
        return " ".join(tokens)


#: A line between the parts of a broken word that isn't running text: scores, sums, banners.
_FURNITURE = regex.compile(r"[0-9０-９\s:.,/|=·〈〉<>()\[\]-]+")


def fields(articles: DataFrame, papers: DataFrame) -> DataFrame:
    """field, id, text of the three fields."""
    a = articles.select("id", F.explode(F.array(F.struct(F.lit("articles.content").alias("field"), F.col("content").alias("text")), F.struct(F.lit("articles.title").alias("field"), F.col("title").alias("text")))).alias("x")).select("x.field", "id", "x.text")
    p = papers.select(F.lit("papers.content").alias("field"), "id", F.col("content").alias("text"))
    return a.unionByName(p).filter("id is not null and text is not null")


def _count_batches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    tally = Tally()

    def out() -> pa.RecordBatch:
        got = tally.keys()
        return pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["key", "n"])

    for b in batches:
        tally.add(b.column(0).to_pylist())
        if len(tally.words) > 1_000_000:
            yield out()
    yield out()


#: Counters in one row of the table that goes to the driver.
_BLOCK = 1 << 16


def _slot_batches(width: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            a = np.asarray([slots(k, width) for k in b.column(0).to_pylist()], np.int64).ravel()
            n = np.repeat(b.column(1).to_numpy(zero_copy_only=False), 2)
            yield pa.RecordBatch.from_arrays([pa.array((a // _BLOCK).astype(np.int32)), pa.array((a % _BLOCK).astype(np.int32)), pa.array(n)], ["block", "slot", "n"])

    return run


def _packed(rows):
    """The counters of one block, as bytes."""
    import pandas as pd

    table = np.bincount(rows["slot"].to_numpy(), rows["n"].to_numpy(np.float64), _BLOCK)
    return pd.DataFrame({"block": rows["block"].iloc[:1], "data": [np.minimum(table, 2**31 - 1).astype("<i4").tobytes()]})


def fit_counts(texts: DataFrame) -> Counts:
    """The language model and channel of all texts: one pass over them, then over the distinct
    words. What reaches the driver is bounded by the sketch (8 bytes x GREATEST) and by the pairs
    of pieces that are met in five words."""
    keys = stage(texts.select("text").mapInArrow(_count_batches, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n")), "keys")
    kept = keys.filter(F.col("n") > SEEN)
    distinct, total = kept.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("key") == "#", F.col("n"))), F.lit(0))).first()
    width = min(max(1 << (16 * distinct).bit_length(), LEAST), GREATEST)
    parts = kept.filter("key <> '#'").mapInArrow(_slot_batches(width), "block int, slot int, n bigint").groupBy("block").applyInPandas(_packed, "block int, data binary")
    table = np.zeros(2 * width, np.int32)
    for r in parts.toLocalIterator():
        table[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["data"], "<i4")
    words = spread(keys.filter(F.col("key").startswith("w")).select(F.expr("substring(key, 2)").alias("w"), "n"))
    sizes, pairs = frequent_and_rare(words)
    met = [tuple(r) for r in pairs.filter("words >= 5").select("true", "printed", "n", "words").collect()]
    trues = texts.sparkSession.createDataFrame(sorted({(m[0],) for m in met}), "true string")
    have = [tuple(r) for r in sizes.join(F.broadcast(trues), "true").select("true", "bucket", "words", "n").collect()]
    return Counts(table, int(total), likely_pairs(have, met))


def paper_names(admins: DataFrame) -> list[str]:
    """Names of newspapers, of at least two characters; the table of accounts is small and fixed."""
    return sorted({n for r in admins.select("press_company").dropna().distinct().collect() if len(n := r["press_company"].strip()) >= 2})


def noise_lines(texts: DataFrame, names: list[str]) -> DataFrame:
    """field, id, line_no (from 1), kind; distinct rows. ``texts``: field, id, text.

    Null and empty texts have none; rows delivered twice give their rows once. With few texts the
    corpus knows few words, and little is called misread besides blots and look-alike parts."""
    spark = texts.sparkSession
    texts = spread(texts)
    counts = fit_counts(texts)
    shared = spark.sparkContext.broadcast((counts.table, counts.total, counts.learned))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(Counts(*shared.value), names)
        for b in batches:
            row, no, kind = [], [], []
            for i, (f, t) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                for n, k in reader.title_kinds(t) if f.endswith(".title") else reader.kinds(t):
                    row.append(i), no.append(n), kind.append(k)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(no, pa.int64()), pa.array(kind, pa.string())], ["field", "id", "line_no", "kind"])

    return texts.select("field", "id", "text").mapInArrow(run, "field string, id bigint, line_no bigint, kind string").distinct()


def repaired(texts: DataFrame, names: list[str]) -> DataFrame:
    """field, id, text: every text as continuous paragraphs; titles without page numbers."""
    spark = texts.sparkSession
    texts = spread(texts)
    counts = fit_counts(texts)
    shared = spark.sparkContext.broadcast((counts.table, counts.total, counts.learned))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        reader = Reader(Counts(*shared.value), names)
        for b in batches:
            got = []
            for f, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if f.endswith(".title"):
                    t = regex.sub(r"^\s*[0-9０-９]{1,3}\s+|\s+[0-9０-９]{1,3}\s*$", "", t)
                got.append(reader.repaired(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string())], ["field", "id", "text"])

    return texts.select("field", "id", "text").mapInArrow(run, "field string, id bigint, text string")
