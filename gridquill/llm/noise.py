"""Repair of text that was read from scanned pages.

Words divided by the layout are put together, misread characters corrected, running headers
and page numbers removed, lines reflowed into paragraphs.

The lexicon is learnt from all texts: words with at least ``SHARE`` of all tokens (so at most
1 / SHARE of them) are frequent. A word is linked to the frequent words with the same glyph
key, a key that is blind to the confusions of recognition (c/e, 1/l/i, rn/m, cl/d, ...). Word
vectors, learnt from all captions and mentions by factorising how often words stand close to each
other, then judge each occurrence: how near the linked word lies to the words around, among all
frequent words, is weighed against how much more frequent it is. Only an occurrence for which both together speak is a misreading; of several
linked words the likeliest is taken.

A document's running headers are the lines that open or close pages which stand close together,
digits apart. The forms that headers of many documents share (kinds of words, numbers and signs)
are learnt as templates, for texts of documents without pages. Null and empty texts have no
defects and stay as they are. Repeated deliveries count once.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquill.llm.canon import CONFUSED, READ_AS, distance, glyph_keys
from gridquill.session import settled

#: Least share and number of a frequent word; how much more frequent a word must be than its misreading.
SHARE, LEAST, TIMES = 2e-6, 4, 25
#: Times at which context alone decides whether a linked word is meant.
PRIOR = 100.0
#: Times below which context isn't asked, and how far (as log odds) context can outweigh them.
LEAST_TIMES, CONTEXT = 5, 5.0
#: Size of the vectors, words before and behind in learning and in judging, and frequent words among which a word's fit is ranked.
VECTOR_SIZE, WINDOW, AROUND, RANKED = 24, 2, 4, 512
#: Share of all words of captions and mentions from which one is too common to say anything of its context.
COMMON = 0.01
#: Texts that are split into words at once.
ROWS_SPLIT = 1000
#: Dimensions of the factorisation beyond those kept, passes over the pairs, and pairs that one task holds while it counts.
SPARE, PASSES, PAIRS_HELD = 16, 3, 4_000_000
#: Pages within which a running header stands again; share of the documents that a form of headers must hold in.
NEAR_PAGES, FORM_SHARE, FORM_LEAST = 5, 2e-3, 3
#: Parts over which a document's texts are spread where they meet its headers.
SALTS = 16
#: Signs at which a layout divides words; ligature signs and their letters.
DIVIDERS = "-¬­‐‑"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: The confusions of ``fold``, which are ASCII, on the bytes of a text.
GLYPHS = bytes(ord(CONFUSED.get(k, chr(k))) for k in range(256))
GLYPH_PAIRS = [(pair.encode(), one.encode()) for pair, one in READ_AS]
PAGE_NUMBER = re.compile(r"(?:(?:page|p\.|pg\.?|seite|s\.)\s*)?[–—|\[({-]*\s*(?:S-?)?\d{1,4}\s*[–—|\])}-]*|page\s+\d{1,4}\s+of\s+\d{1,4}|\d{1,4}\s*/\s*\d{1,4}", re.I)
#: What parts words.
BETWEEN = r"[^\p{L}\p{N}|!$-]+"
AT_GAP = re.compile(rf"[{DIVIDERS}]\s")
NUMBER = re.compile(r"\d+")
PIECE = re.compile(r"\d+|[^\W\d_]+\.?|[^\w\s]")
#: A long small word, as no form of headers has.
SMALL = re.compile(r"(?<![^\W_])[a-z]{4}")
LABELLED = re.compile(r"\s*(?:table|tab|fig|figure|scheme)\b", re.I)
DIVIDED = re.compile(rf"([^\W_]+)([{DIVIDERS}])([ \t]*\n\s*|[ \t]+)([^\W_]+)")
WORD = re.compile(r"[^\W_](?:[^\W_]|[|!$](?=[^\W_]))*(?:[|!$](?=[^\W_])[^\W_]+)*|[|!$](?=[^\W\d_]{2})[^\W_|!$]+")


class Lexicon:
    """Frequent words with their counts, glyph keys and vectors."""

    def __init__(self, counts: dict[str, int], vectors: dict[str, np.ndarray] | None = None, floor: float = 0.2, prior: float = PRIOR):
        self.prior = prior
        self.floor = floor  # stands for the count of a word that is not frequent
        self.counts: dict[str, int] = {}
        for word, n in counts.items():
            self.counts[word] = self.counts.get(word, 0) + n
            if "-" in word:
                for part in word.split("-"):
                    if part:
                        self.counts[part] = self.counts.get(part, 0) + n
        self.vectors = vectors or {}
        ranked = sorted(self.vectors, key=lambda w: (hash_of(w), w))[:RANKED]  # any of the frequent words, the same everywhere
        self.ranked = np.array([self.vectors[w] for w in ranked]) if ranked else None
        self.by_key: dict[str, list[str]] = {}
        for word in self.counts:
            if "-" not in word and sum(c.isalpha() for c in word) >= 2:
                for key in glyph_keys(word):
                    self.by_key.setdefault(key, []).append(word)
        self.sorted = sorted(self.counts)
        self.seen: dict[str, list[str]] = {}

    def known(self, word: str) -> int:
        """The count of a word, or of the word it may be a misreading of."""
        w = word.lower()
        return self.counts.get(w, 0) or max((self.counts[c] for c in self._near(w)), default=0)

    def _near(self, word: str) -> set[str]:
        return {c for key in glyph_keys(word) for c in self.by_key.get(key, ())}

    def begins(self, word: str) -> bool:
        """Whether a frequent word goes on where this one, lower case, ends."""
        at = bisect_right(self.sorted, word)
        return at < len(self.sorted) and self.sorted[at].startswith(word)

    def linked(self, word: str) -> list[tuple[str, float]]:
        """The frequent words of which this one, lower case, may be a misreading, and how many times they are as frequent."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 200_000:
                self.seen.clear()
            n = max(self.counts.get(word, 0), self.floor)
            letters = sum(c.isalpha() for c in word)
            near = sorted(self._near(word)) if letters > 1 and len(word) > 2 else ()
            found = [(c, self.counts[c] / n) for c in near if c != word and c.isalpha() and self.counts[c] >= LEAST_TIMES * n and distance(c, word) <= max(2, 0.45 * len(word))]
            most = max((t for _, t in found), default=0)
            got = self.seen[word] = [(c, t) for c, t in found if t * TIMES > most]  # not one misreading for another
        return got

    def neighbours(self, word: str) -> list[str]:
        """Those of the linked words that are frequent enough to need no context."""
        return [c for c, t in self.linked(word) if t >= TIMES]

    def corrected(self, word: str, around: list[str]) -> str | None:
        """The word read rightly, None if it is no misreading."""
        near = self.linked(word.lower())
        if not near:
            return None
        context = self._context(around)
        odds, best = max((np.log(t / self.prior) + self._fit(c, context), c) for c, t in near)
        if odds < 0:
            return None
        return best.upper() if word.isupper() and len(word) > 1 else best.capitalize() if word[0].isupper() else best

    def _context(self, around: list[str]) -> np.ndarray | None:
        others = [v for w in around if (v := self.vectors.get(w.lower())) is not None]
        return np.mean(others, axis=0) if others else None

    def _fit(self, word: str, context: np.ndarray | None) -> float:
        """Log odds of the word's rank among frequent words by nearness to the context; 0 where either has no vector."""
        own = self.vectors.get(word)
        if own is None or context is None or self.ranked is None:
            return 0.0
        below = float(((self.ranked @ context) < own @ context).mean())
        share = min(max(below, 0.5 / len(self.ranked)), 1 - 0.5 / len(self.ranked))
        return float(np.clip(np.log(share / (1 - share)), -CONTEXT, CONTEXT))


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode())


def form(line: str) -> str:
    """The kinds of a line's pieces, runs of one kind once: capitalised words, words in capitals, numbers; short small words and signs as they are.

    A line all in capitals is of one form, whatever words, numbers and hyphens it has.
    """
    if line.isupper() and "/" not in line and "," not in line:
        return "AA AA" if sum(len(m[0].rstrip(".")) > 3 for m in PIECE.finditer(line) if m[0][0].isalpha()) > 1 else "AA"
    out: list[str] = []
    for m in PIECE.finditer(line):
        t = m[0]
        dot = "." if t[-1] == "." and len(t) > 1 else ""
        w = t.rstrip(".") if dot else t
        kind = "#" if w.isdigit() else t if not w[0].isalpha() else f"Aa{dot}" if w[0].isupper() and (len(w) == 1 or not w.isupper()) else f"AA{dot}" if w.isupper() else t if len(w) <= 3 else f"a{dot}"
        if not out or out[-1] != kind or kind == "#":
            out.append(kind)
    return " ".join(out)


def bare_line(line: str) -> str:
    """A line without a page number at either end."""
    return re.sub(r"^\s*\d{1,4}\s+|\s+\d{1,4}\s*$", "", line).strip()


def _form_pattern(kinds: str) -> re.Pattern[str]:
    """A form as a pattern, to be found where no line ends."""
    small, word, capitals = r"[^\W\d_]+", r"[^\W\d_a-z][^\W\d_]*", r"[^\W\d_a-z]{2,}"
    parts = []
    for k in kinds.split(" "):
        base = {"Aa": word, "AA": capitals, "a": small}.get(k.rstrip(".") or k)
        dot = r"\." if k.endswith(".") and len(k) > 1 else ""
        parts.append(r"\d+" if k == "#" else rf"{base}{dot}(?:\s{base}{dot})*" if base else re.escape(k))
    return re.compile(r"(?<![\w])" + r"\s?".join(parts) + r"(?:\s+\d{1,5}){0,2}(?=\s|$)")


def _flat(text: str) -> str:
    """For comparing headers: lower case, digits masked, glyph key, single spaces."""
    glyphs = NUMBER.sub("#", text.lower()).encode("utf-8", "surrogatepass").translate(GLYPHS)  # as fold() does, for whole texts
    for pair, one in GLYPH_PAIRS:
        glyphs = glyphs.replace(pair, one)
    return " ".join(glyphs.decode("utf-8", "surrogatepass").split())


def _spread(text: str) -> str:
    """Ligature signs as letters."""
    if not text.isascii():
        for sign, letters in LIGATURES.items():
            if sign in text:
                text = text.replace(sign, letters)
    return text


def _header_pattern(header: str) -> re.Pattern[str]:
    parts = [re.escape(p).replace("\\#", r"\d+").replace("#", r"\d+") for p in header.split()]
    return re.compile(r"(?:(?<=\s)\d{1,4}\s+|^\d{1,4}\s+)?" + r"\s+".join(parts) + r"(?:(?:\s+\d{1,5}){1,2}(?=\s*\n|\s*$|\s+[^\W\d_A-Z]{3}))?", re.I)


class Repair:
    """The defects of a text and the text without them."""

    def __init__(self, lexicon: Lexicon, forms: Sequence[str] = ()):
        self.lexicon = lexicon
        self.forms = frozenset(forms)
        # forms with three numbers are too special to be anything else, so they need no line of their own
        special = [f.split(" ") for f in forms if f.split(" ").count("#") >= 3]
        self.within = [_form_pattern(" ".join(f)) for f in special]
        # their numbers and the signs between, which are quickly sought
        numbers = {" ".join(f[f.index("#") : len(f) - f[::-1].index("#")]) for f in special}
        self.sign = re.compile("|".join(r"\s?".join(r"\d+" if k == "#" else re.escape(k) for k in n.split(" ")) for n in sorted(numbers))) if numbers else None
        self.flat: dict[str, str] = {}
        self.sound: set[str] = set()
        self.unsound: set[str] = set()

    def header(self, text: str, headers: Sequence[str]) -> tuple[str, bool]:
        found, flat = False, _flat(text) if len(headers) else ""
        for h in headers:
            key = self.flat.get(h)
            if key is None:
                if len(self.flat) > 50_000:
                    self.flat.clear()
                key = self.flat[h] = _flat(h)
            if key not in flat:
                continue
            if len(key) < 8:  # a short one stands on its own line only
                kept = [x for x in text.split("\n") if _flat(bare_line(x)) != key]
                cleaned = "\n".join(kept)
                if cleaned == text or not cleaned.strip():
                    continue
            else:
                cleaned = _header_pattern(h).sub(" ", text)
                if cleaned == text:  # misread characters within the header: its line goes
                    cleaned = "\n".join(x for x in text.split("\n") if key not in _flat(x))
            found, text, flat = True, cleaned, _flat(cleaned)
        if "\n" in text and self.forms:
            kept = [x for x in text.split("\n") if SMALL.search(x) or LABELLED.match(x) or form(bare_line(x)) not in self.forms]
            if any(x.strip() for x in kept) and len(kept) <= text.count("\n"):
                found, text = True, "\n".join(kept)
        for pattern in self.within if self.sign and self.sign.search(text) else ():
            cleaned = pattern.sub(" ", text)
            if cleaned != text and cleaned.strip():
                found, text = True, cleaned
        return text, found

    def page_number(self, text: str) -> tuple[str, bool]:
        if "\n" not in text:
            return text, False
        lines = text.split("\n")
        kept = [x for x in lines if not (0 < len(x) < 30 and PAGE_NUMBER.fullmatch(x.strip()))]
        return "\n".join(kept), len(kept) < len(lines)

    def divided(self, text: str) -> tuple[str, bool]:
        found = False
        if not AT_GAP.search(text):
            return text, found

        def join(m: re.Match[str]) -> str:
            nonlocal found
            a, sign, gap, b = m.groups()
            if not self._one_word(a, sign, "\n" in gap, b):
                return f"{a}{sign}{b}" if "\n" in gap and sign in "-‐‑" else m[0]
            found = True
            return a + b

        # twice, as a piece may end one division and begin the next
        return DIVIDED.sub(join, DIVIDED.sub(join, text)), found

    def _one_word(self, a: str, sign: str, at_break: bool, b: str) -> bool:
        if not b[0].isalpha() or not a[-1].isalpha() or b[0].isupper() and not a.isupper():
            return False
        whole, compound = self.lexicon.known(a + b), self.lexicon.counts.get(f"{a}-{b}".lower(), 0)
        if not at_break:
            return whole > compound
        if whole or compound:
            return whole > compound
        return sign != "-" or not (self.lexicon.known(a) and self.lexicon.known(b))

    def characters(self, text: str) -> tuple[str, bool]:
        tokens = text.split()
        if self.sound.issuperset(tokens):
            return text, False
        new = set(tokens) - self.sound - self.unsound
        if len(self.sound) + len(self.unsound) + len(new) > 200_000:
            self.sound, self.unsound, new = set(), set(), set(tokens)
        for token in new:
            (self.unsound if self._misread(token) else self.sound).add(token)
        if self.unsound.isdisjoint(tokens):
            return text, False
        plain = _spread(text)
        found = plain != text
        words = [(m[0], m.start(), m.end()) for m in WORD.finditer(plain)]
        out, at = [], 0
        for k, (w, start, end) in enumerate(words):
            unfinished = k + 1 == len(words) and end == len(plain.rstrip()) and self.lexicon.begins(w.lower())
            if not unfinished and self.lexicon.linked(w.lower()):
                around = [x for x, _, _ in words[max(0, k - AROUND) : k + AROUND + 1] if x is not w]
                right = self.lexicon.corrected(w, around)
                if right and right != w:
                    out.append(plain[at:start] + right)
                    at, found = end, True
        return "".join(out) + plain[at:] if out else plain, found

    def _misread(self, token: str) -> bool:
        plain = _spread(token)
        return plain != token or any(self.lexicon.linked(m[0].lower()) for m in WORD.finditer(plain))

    def reflow(self, text: str) -> str:
        """Paragraphs parted by a blank line; a blank line within a sentence parts nothing."""
        blocks = [re.sub(r"\s+", " ", b).strip() for b in re.split(r"\n\s*\n", text)]
        out: list[str] = []
        for b in filter(None, blocks):
            if out and (out[-1][-1] not in ".!?:”)]" or b[0].islower()):
                out[-1] += " " + b
            else:
                out.append(b)
        return "\n\n".join(out)

    def all(self, text: str, headers: Sequence[str], reflow: bool = True) -> tuple[str | None, list[str]]:
        defects, text = [], text.replace("\r\n", "\n")
        for name, step in (("header", lambda t: self.header(t, headers)), ("pageno", self.page_number), ("hyphen", self.divided), ("chars", self.characters)):
            text, found = step(text)
            if found:
                defects.append(name)
        return self.reflow(text) if reflow else None, defects


def texts(tables: DataFrame, mentions: DataFrame) -> DataFrame:
    """field, item_id, document_id, engine, text of captions and mentions, as delivered."""
    return (
        tables.select(F.lit("caption").alias("field"), F.col("table_no").alias("item_id"), "document_id", "engine", F.col("caption").alias("text"))
        .unionByName(mentions.select(F.lit("mention").alias("field"), F.col("mention_id").alias("item_id"), "document_id", "engine", "text"))
        .where("length(text) > 0")
    )


def words(texts_: pa.Array) -> pa.Array:
    """Lists of the words of lower-case texts, compounds whole."""
    return pc.split_pattern_regex(texts_, BETWEEN)


def word_counts(items: DataFrame, pages: DataFrame) -> DataFrame:
    """word, n, own over two one-column relations of texts; ``own`` are its occurrences in the first. Single letters are counted there only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pc.list_flatten(words(batch.column(0).slice(k, ROWS_SPLIT))).value_counts() for k in range(0, len(batch), ROWS_SPLIT)]
            every = pa.table([pa.chunked_array([x.field(k) for x in parts], t) for k, t in enumerate((pa.string(), pa.int64()))], ["word", "n"])
            yield from every.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    parts = [c.select(F.lower(F.col(c.columns[0])).alias("text")).where("text <> ''").mapInArrow(run, "word string, n bigint").select("word", "n", own.alias("own")) for c, own in ((items, F.col("n")), (pages, F.lit(0).cast("bigint")))]
    return parts[0].unionByName(parts[1]).where("length(word) > 1 or own > 0 and word <> ''").groupBy("word").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))


def pair_counts(items: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """a, b, n: how often two words of the vocabulary (by number, a <= b) stand within ``WINDOW`` of each other, the nearest counted most.

    Words outside the vocabulary are passed over, as in skip-gram learning. Counts are integers, so
    they don't depend on how the texts are laid out.
    """
    shared, size = items.sparkSession.sparkContext.broadcast(list(vocabulary)), len(vocabulary)

    def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        code, at = np.unique(np.concatenate(codes), return_inverse=True)
        return code, np.bincount(at, np.concatenate(counts), len(code)).astype(np.int64)

    def rows(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((code // size).astype(np.int32)), pa.array((code % size).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pa.array(shared.value, pa.string())
        codes, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            split = words(batch.column("text"))
            found = pc.index_in(pc.list_flatten(split), value_set=index)
            known = found.is_valid().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))[known]
            word = found.drop_null().to_numpy().astype(np.int64)
            for far in range(1, WINDOW + 1):
                same = text[:-far] == text[far:]
                one, other = word[:-far][same], word[far:][same]
                codes.append(np.minimum(one, other) * size + np.maximum(one, other))
                counts.append(np.full(len(one), WINDOW + 1 - far))
                held += len(one)
            if held > PAIRS_HELD:
                code, n = summed(codes, counts)
                codes, counts, held = [code], [n], len(code)
                if held > PAIRS_HELD // 2:
                    yield rows(code, n)
                    codes, counts, held = [code[:0]], [n[:0]], 0
        yield rows(*summed(codes, counts))

    return items.select(F.lower("text").alias("text")).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def vectors(items: DataFrame, vocabulary: Sequence[str]) -> dict[str, np.ndarray]:
    """Vectors of unit length of the vocabulary's words, from every text.

    What skip-gram learning with negative samples approaches step by step is the factorisation of
    how much more often two words meet than by chance (their pointwise mutual information). Here
    it is factorised itself, by subspace iteration over the counted pairs: each pass multiplies
    it with a few columns. So vectors depend neither on files nor on the order of texts.
    """
    size = len(vocabulary)
    if not size:
        return {}
    both_ways = "inline(if(a = b, array(named_struct('a', a, 'b', b)), array(named_struct('a', a, 'b', b), named_struct('a', b, 'b', a))))"
    pairs = settled(pair_counts(items, vocabulary).selectExpr(both_ways, "n").repartition("a").sortWithinPartitions("a", "b"))
    context, sums = items.sparkSession.sparkContext, np.zeros(size)
    for r in pairs.groupBy("a").agg(F.sum("n").alias("n")).collect():  # at most 1 / SHARE words
        sums[r["a"]] = r["n"]

    def times(columns: np.ndarray) -> np.ndarray:
        width, shared = columns.shape[1], context.broadcast((columns.astype(np.float32), sums))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by, total = shared.value
            for batch in batches:
                a, b, n = (batch.column(c).to_numpy() for c in ("a", "b", "n"))
                if len(a):
                    more = np.maximum(np.log(n * total.sum() / (total[a] * total[b])), 0)
                    starts = np.flatnonzero(np.diff(a, prepend=-1))
                    got = np.add.reduceat(more[:, None] * by[b], starts).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.ListArray.from_arrays(np.arange(len(starts) + 1, dtype=np.int32) * width, got.ravel())], ["a", "v"])

        got = pairs.mapInArrow(run, "a int, v array<float>").toArrow()
        out = np.zeros((size, width))
        np.add.at(out, got["a"].to_numpy(), pc.list_flatten(got["v"]).to_numpy().reshape(-1, width))
        shared.destroy()
        return out

    basis = np.random.default_rng(7).normal(size=(size, min(size, VECTOR_SIZE + SPARE)))
    for _ in range(PASSES):
        basis = np.linalg.qr(basis)[0]
        got = times(basis)
        last, basis = basis, got
    value, turn = np.linalg.eigh((last.T @ got + got.T @ last) / 2)
    best = [k for k in np.argsort(-value)[:VECTOR_SIZE] if value[k] > 1e-6]
    own = last @ turn[:, best] * np.sqrt(value[best])
    length = np.linalg.norm(own, axis=1)
    return {w: (v / d).astype(np.float32) for w, v, d in zip(vocabulary, own, length, strict=True) if d > 1e-6}


def learn(items: DataFrame, pages: DataFrame, with_vectors: bool = True) -> Lexicon:
    """The lexicon of all captions, mentions and pages."""
    counted = settled(word_counts(items.select("text"), pages.select("text")).where(f"n >= {LEAST}"))
    whole, n_own = counted.where("length(word) > 1").agg(F.sum("n"), F.sum("own")).first()
    whole = whole or 0
    least = max(LEAST, SHARE * whole)
    frequent = {r["word"]: r["n"] for r in counted.where((F.col("n") >= least) & (F.length("word") > 1)).collect()}  # at most 1 / SHARE words
    own: dict[str, np.ndarray] = {}
    if with_vectors:
        # words too common ("the", "of") tell nothing of their neighbours and are passed over
        learnt = counted.where((F.col("own") >= int(max(5, least))) & (F.col("own") <= COMMON * (n_own or 0)))
        own = vectors(items, sorted(r["word"] for r in learnt.select("word").collect()))
    return Lexicon(frequent, own, max(0.2, SHARE * whole / 8))


def header_lines(pages: DataFrame) -> DataFrame:
    """document_id, header (small letters, digits masked), line (as on one page): lines that open or close pages close to each other."""
    text = F.trim(F.col("text"), F.lit("\n "))
    edge = F.split(F.concat_ws("\n", F.substring_index(text, "\n", 3), F.substring_index(text, "\n", -4)), "\n")
    line = F.trim(F.regexp_replace(F.trim("line"), r"^\d{1,4}\s+|\s+\d{1,4}$", ""))
    seen = (
        pages.where("text is not null")
        .select("document_id", "page", F.explode(edge).alias("line"))
        .where(r"line not rlike '^\\s*#' and line rlike '\\p{L}{3}' and line rlike '^[^\\p{Ll}]' and line not rlike '[.;?!]$'")
        .select("document_id", "page", line.alias("line"))
        .groupBy("document_id", F.regexp_replace(F.lower("line"), r"\d+", "#").alias("header"))
        .agg(F.array_sort(F.collect_set("page")).alias("on"), F.min("line").alias("line"))  # the page numbers of one line of one document
    )
    near = F.exists(F.sequence(F.lit(1), F.size("on") - 1), lambda i: F.get("on", i) - F.get("on", i - 1) <= NEAR_PAGES)
    return seen.where(F.size("on") >= 2).where(near).select("document_id", "header", "line")


def running_headers(pages: DataFrame) -> DataFrame:
    """document_id, headers array<string>: the headers of one document, digits masked."""
    return header_lines(pages).groupBy("document_id").agg(F.collect_list("header").alias("headers"))


def forms_of(lines: DataFrame) -> list[str]:
    """The forms of headers that stand in a share of ``FORM_SHARE`` of the documents with headers, so at most some 1 / FORM_SHARE."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"document_id": batch["document_id"], "form": [form(x) for x in batch["line"]]})

    every = settled(lines.select("document_id", "line").mapInPandas(run, "document_id string, form string").distinct())
    held = every.groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    least = max(FORM_LEAST, FORM_SHARE * every.select("document_id").distinct().count())
    prose = F.col("form").rlike(r"(^| )a\.?( |$)")  # long small words: a sentence or title that stands on several pages
    return sorted(r["form"] for r in held.where((F.col("n") >= least) & F.col("form").contains(" ") & ~prose).collect())


def with_headers(items: DataFrame, lines: DataFrame) -> DataFrame:
    """``items`` with the headers of their document, whose texts are spread over ``SALTS`` parts."""
    headers = lines.groupBy("document_id").agg(F.sort_array(F.collect_list("header")).alias("headers")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int"))
    return salted.join(headers, ["document_id", "salt"], "left").drop("salt")


def repaired(tables: DataFrame, mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """field, item_id, text (repaired), defects array<string>; one row per text."""
    checked = _checked(tables, mentions, pages, reflow=True)
    return checked.dropDuplicates(["field", "item_id"])


def _checked(tables: DataFrame, mentions: DataFrame, pages: DataFrame, reflow: bool, with_vectors: bool = True) -> DataFrame:
    """The texts as delivered with their defects; without ``reflow`` the text itself is left out."""
    items = texts(tables, mentions)
    lines = settled(header_lines(pages))
    shared = items.sparkSession.sparkContext.broadcast((learn(items, pages, with_vectors), forms_of(lines)))  # at most 1 / SHARE words, 1 / FORM_SHARE forms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = Repair(*shared.value)
        for batch in batches:
            got = [tool.all(t, () if h is None else h, reflow) for t, h in zip(batch["text"], batch["headers"], strict=True)]
            yield pd.DataFrame({"field": batch["field"], "item_id": batch["item_id"], "text": [g[0] for g in got], "defects": [g[1] for g in got]})

    joined = with_headers(items, lines).select("field", "item_id", "text", "headers")
    return joined.mapInPandas(run, "field string, item_id bigint, text string, defects array<string>")


def found(tables: DataFrame, mentions: DataFrame, pages: DataFrame, with_vectors: bool = True) -> DataFrame:
    """field, item_id, defect: one row for each text and defect it has; ``with_vectors`` off shows what the vectors do."""
    return _checked(tables, mentions, pages, reflow=False, with_vectors=with_vectors).select("field", "item_id", F.explode("defects").alias("defect")).distinct()
