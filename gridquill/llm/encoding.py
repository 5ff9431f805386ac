"""Texts decoded with the wrong character encoding: found, explained by a chain, restored.

A multinomial classifier over hashed byte bigrams is trained on words of the corpus that were
garbled on purpose by every chain in ``CHAINS``; it ranks the chains for each word that holds
a character beyond ASCII. The best chains are inverted in that order. An inversion counts
only if it is strictly decodable: every character must have a byte in the wrong encoding, and
the bytes must be valid in the right one. UTF-8 is so strict that this settles it; for
single-byte and double-byte originals, which decode almost anything, the classifier must also
prefer the chain by ``MARGIN`` and find the result clean. Inversion repeats until nothing is
left to invert, so double garbling and garbling written as numeric entities come out as well.
A replacement character (U+FFFD) marks a passage whose original is lost.

Words are judged one by one, and each distinct word once per batch, so garbled passages are
found within clean documents. Where nothing parts a garbled passage from clean characters, as
in Chinese, the stretches that the wrong encoding holds or that are strict UTF-8 are judged alone. Null, empty and pure-ASCII texts are never affected. Repeated
rows come out as often as they went in. One narrow pass over all rows and whole texts; the
training sample (``SAMPLE`` documents, ``SAMPLE_CHARS`` characters of each) is the only bound.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, and characters of each, from which the classifier learns.
SAMPLE, SAMPLE_CHARS = 3_000, 6_000
#: Buckets of hashed byte bigrams; nats by which a chain must beat "clean" where strict decoding proves little.
BUCKETS, MARGIN = 1 << 14, 8.0

#: Steps (right encoding, wrong encoding); a text was encoded by the right one and decoded by the wrong one.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    "utf-8>cp1252": (("utf-8", "cp1252"),),
    "utf-8>latin-1": (("utf-8", "latin-1"),),
    "utf-8>cp437": (("utf-8", "cp437"),),
    "utf-8>cp850": (("utf-8", "cp850"),),
    "utf-8>cp1250": (("utf-8", "cp1250"),),
    "utf-8>iso8859-2": (("utf-8", "iso8859-2"),),
    "utf-8>iso8859-15": (("utf-8", "iso8859-15"),),
    "utf-8>cp1251": (("utf-8", "cp1251"),),
    "utf-8>cp1253": (("utf-8", "cp1253"),),
    "utf-8>cp1254": (("utf-8", "cp1254"),),
    "utf-8>mac-roman": (("utf-8", "mac-roman"),),
    "utf-8>koi8-r": (("utf-8", "koi8-r"),),
    "utf-8>cp866": (("utf-8", "cp866"),),
    "utf-8>gb18030": (("utf-8", "gb18030"),),
    "utf-8>big5": (("utf-8", "big5"),),
    "utf-8>cp932": (("utf-8", "cp932"),),
    "utf-8>cp1252>utf-8>cp1252": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf-8>latin-1>utf-8>latin-1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf-8>latin-1>utf-8>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    "gb18030>cp1252": (("gb18030", "cp1252"),),
    "gb18030>latin-1": (("gb18030", "latin-1"),),
    "big5>cp1252": (("big5", "cp1252"),),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "cp1251>latin-1": (("cp1251", "latin-1"),),
    "cp1251>koi8-r": (("cp1251", "koi8-r"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "cp1251>mac-roman": (("cp1251", "mac-roman"),),
    "koi8-r>cp1251": (("koi8-r", "cp1251"),),
    "koi8-r>cp1252": (("koi8-r", "cp1252"),),
    "koi8-r>cp866": (("koi8-r", "cp866"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
    "cp866>cp1252": (("cp866", "cp1252"),),
    "cp866>cp437": (("cp866", "cp437"),),
    "cp866>koi8-r": (("cp866", "koi8-r"),),
    "cp1252>mac-roman": (("cp1252", "mac-roman"),),
    "cp1252>cp437": (("cp1252", "cp437"),),
    "cp1252>cp850": (("cp1252", "cp850"),),
    "cp1252>cp1250": (("cp1252", "cp1250"),),
    "cp1252>cp1251": (("cp1252", "cp1251"),),
    "mac-roman>cp1252": (("mac-roman", "cp1252"),),
    "cp437>cp1252": (("cp437", "cp1252"),),
    "cp850>cp1252": (("cp850", "cp1252"),),
}
NAMES = ["clean", *CHAINS]
ENTITY = re.compile(r"&#\d{2,6};")
HIGH = re.compile(r"[^\x00-\x7f]+")
#: Bytes of strict UTF-8 beyond ASCII; in wide encodings, where one character often is a sequence of two bytes by chance, only such of three.
STRICT = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
STRICT_WIDE = re.compile(rb"(?:[\xe1-\xef][\x80-\xbf]{2}){2,}")


class Codec:
    """An encoding in which bytes without a character stand for themselves, as decoders in the wild treat them."""

    _tables: dict[str, tuple[list[str], dict[str, int]]] = {}
    WIDE = ("utf-8", "gb18030", "big5", "cp932")

    @classmethod
    def _table(cls, name: str) -> tuple[list[str], dict[str, int]]:
        if name not in cls._tables:
            chars = []
            for b in range(256):
                try:
                    chars.append(bytes([b]).decode(name))
                except UnicodeDecodeError:
                    chars.append(chr(b))
            cls._tables[name] = chars, {c: b for b, c in reversed(list(enumerate(chars)))}
        return cls._tables[name]

    @classmethod
    def decode(cls, data: bytes, name: str) -> str | None:
        if name in cls.WIDE:
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                return None
        chars = cls._table(name)[0]
        return "".join([chars[b] for b in data])

    @classmethod
    def encode(cls, text: str, name: str) -> bytes | None:
        if name in cls.WIDE:
            try:
                return text.encode(name)
            except UnicodeEncodeError:
                return None
        back = cls._table(name)[1]
        try:
            return bytes([back[c] for c in text])
        except KeyError:
            return None


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it; None if it can't be written in the right encoding."""
    for right, wrong in CHAINS[chain]:
        data = Codec.encode(text, right)
        if data is None or (got := Codec.decode(data, wrong)) is None:
            return None
        text = got
    return text


def invert(text: str, chain: str) -> str | None:
    """The original of a garbled text; None if it isn't strictly decodable or nothing changes."""
    now = text
    for right, wrong in reversed(CHAINS[chain]):
        data = Codec.encode(now, wrong)
        if data is None or (got := Codec.decode(data, right)) is None:
            return None
        now = got
    return None if now == text else now


def bigrams(word: str) -> np.ndarray:
    """Buckets of the byte bigrams in which a byte beyond ASCII takes part."""
    data = np.frombuffer(b"^" + word.encode("utf-8", "surrogatepass") + b"$", np.uint8).astype(np.int64)
    pair = (data[:-1] << 8) | data[1:]
    pair = pair[(data[:-1] > 127) | (data[1:] > 127)]
    return (pair * 40503) % 65537 % BUCKETS


class Classifier:
    """Multinomial naive Bayes over hashed byte bigrams.

    ``weights`` holds log probabilities by bucket and chain, ``blocks`` the stretches of 128
    characters that the corpus uses: an inversion into any other script is no restoration.
    """

    def __init__(self, weights: np.ndarray, blocks: frozenset[int]):
        self.weights, self.blocks = weights, blocks

    @classmethod
    def trained(cls, words: Counter[str]) -> Classifier:
        """From the words of the sample, each with the number of documents that hold it."""
        used: Counter[int] = Counter()
        for word, n in words.items():
            for block in {_block(c) for c in word}:
                used[block] += n
        blocks = frozenset(b for b, n in used.items() if n >= 3)
        counts = np.full((BUCKETS, len(NAMES)), 0.05)
        for word, n in words.items():
            if _suspect(word, n, words, blocks):
                continue
            weight = min(n, 20) ** 0.5
            for k, name in enumerate(NAMES):
                seen = word if not k else garble(word, name)
                if seen is not None and (not k or seen != word):
                    np.add.at(counts[:, k], bigrams(seen), weight)
        return cls(np.log(counts / counts.sum(0)).astype(np.float32), blocks)

    def scores(self, word: str) -> np.ndarray:
        return self.weights[bigrams(word)].sum(0)

    def clean(self, word: str) -> float:
        """How well the word fits clean text, per bigram."""
        at = bigrams(word)
        return float(self.weights[at, 0].mean()) if len(at) else 0.0

    def sane(self, word: str) -> bool:
        return _sane(word, self.blocks)


def _block(c: str) -> int:
    """A character's stretch of 128; ideographs and Hangul count as one each."""
    n = ord(c)
    return 0x4E00 >> 7 if 0x3400 <= n <= 0x9FFF else 0xAC00 >> 7 if 0xAC00 <= n <= 0xD7FF else n >> 7


def _sane(word: str, blocks: frozenset[int]) -> bool:
    """No control characters beyond ASCII, replacement characters or scripts that the corpus doesn't use."""
    return all((c < "\x7f" or c >= "\xa0") and c != "\ufffd" and _block(c) in blocks for c in word)


def _suspect(word: str, n: int, words: Counter[str], blocks: frozenset[int]) -> bool:
    """Words that mustn't be learnt as clean: what is lost, an entity, strict UTF-8 in disguise, or a frequent word's garbled form."""
    if "\ufffd" in word or "&#" in word or any("\x7f" < c < "\xa0" for c in word):
        return True
    for name in CHAINS:
        if name.startswith("utf-8"):
            if name.count(">") == 1 and n < 30:
                got = invert(word, name) or (None if name[6:] in Codec.WIDE else _utf8_runs(word, name))
                if got and _sane(got, blocks):
                    return True
                if name[6:] not in Codec.WIDE and any(e - b > 3 and (part := invert(word[b:e], name)) and _sane(part, blocks) for b, e in _strict_spans(word, name[6:])):
                    return True
        elif (got := invert(word, name)) and words.get(got, 0) >= 3 * n:
            return True
    return False


def words_of(text: str) -> set[str]:
    """The distinct words that hold a character beyond ASCII or a numeric entity."""
    parts = set(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
    return {w for w in parts if not w.isascii() or "&#" in w}


def _utf8_runs(word: str, chain: str) -> str | None:
    """Restores the stretches of a partly garbled word that are strict UTF-8 on their own."""
    changed = False

    def one(m: re.Match[str]) -> str:
        nonlocal changed
        got = invert(m[0], chain) if len(m[0]) > 1 else None
        changed |= got is not None
        return m[0] if got is None else got

    out = HIGH.sub(one, word)
    return out if changed else None


def _strict_spans(word: str, wrong: str) -> list[tuple[int, int]]:
    """Stretches within a run beyond ASCII whose bytes in a narrow encoding are strict UTF-8, where the run goes on."""
    back = Codec._table(wrong)[1]
    data = bytes([back.get(c, 0) for c in word])
    out = []
    for m in STRICT.finditer(data):
        before, after = word[m.start() - 1 : m.start()] if m.start() else "", word[m.end() : m.end() + 1]
        if (before + after).isascii():
            continue  # a whole run
        held = any(c > "\x7f" and c in back for c in before + after)
        if not held or sum(b >= 0xC0 for b in m[0]) > 1:
            out.append(m.span())
    return out


def _wide_spans(word: str, wrong: str) -> list[tuple[int, int]]:
    """Longest stretches of whole characters whose bytes in a wide encoding are strict UTF-8, two originals at least."""
    out = []
    for run in HIGH.finditer(word):
        data, offsets = b"", [0]
        for c in run[0]:
            data += Codec.encode(c, wrong) or b"\0"
            offsets.append(len(data))
        at = {o: i for i, o in enumerate(offsets)}
        i = 0
        while i < len(run[0]):
            m = STRICT_WIDE.match(data, offsets[i])
            ends = [e for e in range(m.end(), m.start() + 5, -3) if e in at] if m else []
            if ends:
                out.append((run.start() + i, run.start() + at[ends[0]]))
                i = at[ends[0]]
            else:
                i += 1
    return out


def _held_spans(word: str, wrong: str) -> list[tuple[int, int]]:
    """Stretches of two characters beyond ASCII at least that a narrow encoding holds, where the word goes on with others."""
    back, out, start = Codec._table(wrong)[1], [], 0
    for k in range(len(word) + 1):
        if k == len(word) or word[k] > "\x7f" and word[k] not in back:
            if k - start < len(word) and sum(c > "\x7f" for c in word[start:k]) > 1:
                out.append((start, k))
            start = k + 1
    return out


NARROW = sorted({w for steps in CHAINS.values() for _, w in steps} - set(Codec.WIDE))


def _explain_parts(word: str, model: Classifier) -> tuple[str, str] | None:
    """As ``_explain_once`` of a word in which garbled and clean characters stand without a space between: each stretch is judged alone."""
    wide = {x for w in Codec.WIDE[1:] for x in _wide_spans(word, w)}
    spans = wide | {x for w in NARROW for x in (*_held_spans(word, w), *_strict_spans(word, w))}
    spans.discard((0, len(word)))
    first, taken = None, []
    for start, end in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if any(start < e and s < end for s, e, _ in taken):
            continue
        part = word[start:end]
        got = _explain_once(part, model)
        if got is None or (start, end) in wide and model.scores(part)[NAMES.index(got[0])] - model.scores(part)[0] < MARGIN:
            continue
        if got[0] == "lost":
            return got[0], word
        first = first or got[0]
        taken.append((start, end, got[1]))
    for start, end, right in sorted(taken, reverse=True):
        word = word[:start] + right + word[end:]
    return (first, word) if first else None


def explain(word: str, model: Classifier) -> tuple[str, str] | None:
    """(chain, restored word) of a garbled word, ("lost", word) if it can't be restored, None if it is clean."""
    first, now = None, word
    if "&#" in now and ENTITY.search(now):
        now = html.unescape(now)
        if now.isascii():
            return None
    for _ in range(4):
        got = _explain_once(now, model) or _explain_parts(now, model)
        if got is None:
            break
        first = first or got[0]
        if got[0] == "lost":
            return first, word
        now = got[1]
        if now.isascii():
            break
    if first and "\ufffd" not in now:
        return first, now
    return ("lost", word) if first or "\ufffd" in word else None


def _explain_once(word: str, model: Classifier) -> tuple[str, str] | None:
    scores = model.scores(word)
    order = np.argsort(-scores, kind="stable")
    high = sum(c > "\x7f" for c in word)
    strict: dict[str, str] = {}  # restored word -> likeliest chain
    for k in order:
        name = NAMES[k]
        if not k:
            continue
        if name.startswith("utf-8"):
            if scores[k] < scores[0]:
                continue
            got = invert(word, name)
            if got is None and high > 1 and name.count(">") == 1 and name[6:] not in Codec.WIDE:
                got = _utf8_runs(word, name)
            if got is not None and model.sane(got):
                strict.setdefault(got, name)
        elif not strict and scores[k] - scores[0] >= MARGIN and high >= 3 and (got := invert(word, name)) and model.sane(got):
            again = model.scores(got)
            if got.isascii() or again[0] >= again.max() - 2.0:
                return name, got
    if strict:
        best = max(strict, key=model.clean) if len(strict) > 1 else next(iter(strict))
        return strict[best], best
    best = order[0]
    if best and "gb18030" in NAMES[best] and high >= 6 and scores[best] - scores[0] >= 4 * MARGIN:
        return "lost", word
    return None


def alike(word: str, chain: str, model: Classifier) -> str | None:
    """The restored form of a short word in a document where the chain is proven by other words."""
    if not (got := invert(word, chain)) or not model.sane(got):
        return None
    scores = model.scores(word)
    return got if chain.startswith("utf-8") or scores[NAMES.index(chain)] > scores[0] else None


def train(documents: DataFrame, sample: int = SAMPLE) -> Classifier:
    """The classifier learnt from the words of about ``sample`` documents taken by hash."""
    share = min(1.0, sample / max(documents.count(), 1))
    taken = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 33) < int(share * 2**31)
    rows = documents.where(taken).select(F.expr(f"left(text, {SAMPLE_CHARS})").alias("t")).where("length(t) > 0").limit(2 * sample).collect()  # at most 2 * sample short texts
    words: Counter[str] = Counter()
    for (text,) in rows:
        words.update(words_of(text))
    return Classifier.trained(words)


def restore(documents: DataFrame, model: Classifier | None = None, affected_only: bool = False) -> DataFrame:
    """doc_id, text (restored where possible), chains map<string,int>, lost int: words by chain, words not restored."""
    model = model or train(documents)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.blocks))  # BUCKETS x chains floats: 2.8 MB, fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, known = Classifier(*shared.value), {}
        for batch in batches:
            ids, texts, chains, lost = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by: Counter[str] = Counter()
                swap = {}
                if text and (not text.isascii() or "&#" in text):
                    for w in words_of(text):
                        if w in known:
                            got = known[w]
                        else:
                            if len(known) > 200_000:
                                known.clear()
                            got = known[w] = explain(w, judge)
                        if got:
                            by[got[0]] += 1
                            swap[w] = got[1]
                    for chain in [c for c in by if c != "lost"]:
                        for w in words_of(text) - swap.keys():
                            if (more := alike(w, chain, judge)) is not None:
                                by[chain] += 1
                                swap[w] = more
                if swap:
                    text = re.sub(r"[^ \n\t\r]+", lambda m: swap.get(m[0], m[0]), text)  # noqa: B023
                elif affected_only:
                    continue
                ids.append(doc_id)
                texts.append(text)
                chains.append(list(by.items()))
                lost.append(by.get("lost", 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(chains, pa.map_(pa.string(), pa.int32())), pa.array(lost, pa.int32())],
                names=["doc_id", "text", "chains", "lost"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, text string, chains map<string,int>, lost int")


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document with at least one garbled passage."""
    return restore(documents, affected_only=True).select("doc_id").distinct()
