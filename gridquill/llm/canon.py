"""Freely typed values mapped to the entries of a reference list.

Two passes over each value, equal values once per task. First an automaton over the list's names
and aliases (short forms, forms with "&" or "/" for "and", forms without spaces) finds embedded
mentions at word boundaries; of overlapping ones the longest wins, and all that are left are
reported. The longest gives the entry, the leftmost of equals; a word that only accompanies names
("results") gives way to any other. Values without a mention go to token-set similarity: every
content word of a name must have its own word in the value, equal up to abbreviation or typing and
recognition errors, and words left over count against it; values whose words run together or apart
are compared as a whole. An index of letter pairs finds the entries that can reach ``LEAST`` at
all, so the work doesn't grow with the list. Below ``LEAST`` a value is unmatched.

Null and blank values give no row, unmatched ones id 0. Ties go to the smaller id. An empty
list leaves every value unmatched. Repeated deliveries of a row count once. A list of more than
``MOST_ENTRIES`` is refused, as every worker holds it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquill.session import delivered_once

#: Least similarity of a value to the entry it is given.
LEAST = 0.78
#: Entries that a list may have: a few hundred bytes each on every worker.
MOST_ENTRIES = 1_000_000
#: Characters that recognition confuses, folded to one of them, and pairs (of folded characters) read as one letter.
CONFUSED = str.maketrans({"1": "l", "|": "l", "!": "l", "i": "l", "j": "l", "0": "o", "c": "e", "6": "b", "h": "b", "9": "g", "q": "g", "5": "s", "$": "s", "v": "y", "8": "b", "3": "e"})
READ_AS = (("rn", "m"), ("rl", "n"), ("el", "d"), ("ll", "u"), ("yy", "w"))
#: Words that add nothing to a name, and words that only accompany an alias.
EMPTY = {"and", "of", "the", "on", "in", "for", "a", "an", "to", "with"}
COMPANY = {"continued", "contd", "cont", "part", "results", "result", "analysis", "data", "study", "studies", "section", "measurements", "spectra"}
#: Symbols and contractions that stand for a word of a name.
SHORT_WORDS = {"n2": "nitrogen", "ir": "infrared", "expt": "experimental"}
NUMBERING = re.compile(r"^\s*(?:[#*>§\s]+|\(?[a-z]\)\s*|(?:\d+(?:\.\d+)*\.?|[ivx]+\.)(?=[\s(#*]|$)\s*|\d+(?:\.\d+)*\.?\s*(?=[^\W\d]))", re.I)
ENDING = re.compile(r"[\s.:;,*_–—-]*(?:\(?\s*cont(?:inue|[’'`]?)d\.?\s*\)?|[–—-]\s*part\s+\d+)?[\s.:;,*_]*$", re.I)


def bare(value: str) -> str:
    """The value without numbering, mark-up, continuation notes; lower case, single spaces."""
    text = re.sub(r"[\s_\u00a0\u2000-\u200b\u202f\u3000]+", " ", value.replace("\u00ad", "")).strip()
    before = None
    while before != text:
        before = text
        text = NUMBERING.sub("", text, count=1)
    text = ENDING.sub("", ENDING.sub("", text)).strip("*# ").lower()
    if re.fullmatch(r"(?:\w ){3,}\w", text):  # letters set apart
        text = text.replace(" ", "")
    return text


@lru_cache(maxsize=100_000)
def fold(text: str) -> str:
    text = text.translate(CONFUSED)
    for pair, one in READ_AS:
        text = text.replace(pair, one)
    return text


@lru_cache(maxsize=200_000)
def glyph_keys(word: str) -> frozenset[str]:
    """The folded forms of a word; pairs can be read in different orders ("riins": r-ii-n-s or ri-i-n-s)."""
    plain = word.translate(CONFUSED)
    u_first, u_last = plain.replace("ll", "u"), plain[::-1].replace("ll", "u")[::-1]
    out = {fold(word)}
    for t in (plain, u_first, u_last):
        for pair, one in (("rl", "n"), ("rn", "m"), ("el", "d"), ("ll", "u"), ("yy", "w")):
            t = t.replace(pair, one)
        out.add(t)
    return frozenset(out)


def pairs_of(word: str) -> set[str]:
    """The pairs of neighbouring letters of a word, with its ends; folded ones apart from typed ones."""
    typed, folded = f"^{word}$", f"^{fold(word)}$"
    return {typed[k : k + 2] for k in range(len(typed) - 1)} | {"~" + folded[k : k + 2] for k in range(len(folded) - 1)}


def squeeze(text: str) -> str:
    return re.sub(r"[^\w|!$]+", "", text)


def distance(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours counting as one (bit-parallel, after Hyyrö)."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, diagonal, before, score = full, 0, 0, 0, len(a)
    for c in b:
        at = places.get(c, 0)
        swap = ((~diagonal & at) << 1) & before
        diagonal = ((((at & up) + up) ^ up) | at | down | swap) & full
        high, low = down | (full & ~(diagonal | up)), diagonal & up
        score += bool(high & last) - bool(low & last)
        high, low = (high << 1 | 1) & full, low << 1 & full
        up, down, before = (low | (full & ~(diagonal | high))) & full, high & diagonal, at
    return score


@lru_cache(maxsize=100_000)
def _letters(text: str) -> int:
    """The characters of a folded text as a bit set."""
    out = 0
    for c in fold(text):
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    """Similarity of two words: edits as typed, or as recognition reads them."""
    if a == b:
        return 1.0
    if abs(len(a) - len(b)) > 3 + max(len(a), len(b)) // 4:
        return 0.0
    m, n = _letters(a), _letters(b)
    if 2 * (m & n).bit_count() < max(m.bit_count(), n.bit_count()):
        return 0.0  # too few letters in common for any likeness that counts
    x, y = fold(a), fold(b)
    return max(1 - distance(a, b) / max(len(a), len(b)), 0.97 - distance(x, y) / max(len(x), len(y)))


class Canon:
    """A list's names, aliases and automaton."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        import ahocorasick

        self.entries = [(i, n.strip().lower(), (s or "").strip().lower()) for i, n, s in sorted(entries) if n and n.strip()]
        self.automaton = ahocorasick.Automaton()
        self.words = {i: [w for w in re.findall(r"\w+", n) if w not in EMPTY] for i, n, _ in self.entries}
        for i, name, short in self.entries:
            forms = {name, name.replace("-", " "), name.replace(" and ", " & "), name.replace(" and ", " / "), name.replace(" and ", "/"), name + "s", squeeze(name)}
            for form in forms:
                if form not in self.automaton:
                    self.automaton.add_word(form, (len(form), i))
            if short and short not in self.automaton:
                self.automaton.add_word(short, (len(short), i))
        if self.entries:
            self.automaton.make_automaton()
        self.by_id = {i: (n, s) for i, n, s in self.entries}
        self.holders: dict[str, set[int]] = {}  # a word of a name, or a name as a whole -> its entries
        self.grams: dict[str, list[str]] = {}  # a pair of letters, as typed or folded -> the words that have it
        self.starts: dict[str, list[str]] = {}  # two letters -> the words that begin with them
        for i, name, _ in self.entries:
            for w in {*self.words[i], squeeze(name)}:
                if w not in self.holders:
                    for g in pairs_of(w):
                        self.grams.setdefault(g, []).append(w)
                    for start in {w[:2], fold(w)[:2]}:
                        self.starts.setdefault(start, []).append(w)
                self.holders.setdefault(w, set()).add(i)
        for got, want in SHORT_WORDS.items():
            if want in self.holders:
                self.starts.setdefault(got, []).append(want)
        self.near: dict[str, frozenset[int]] = {}

    def candidates(self, word: str) -> frozenset[int]:
        """The entries with a word that this one can stand for.

        An entry reaches ``LEAST`` only if one of its words is as like as that: at most 0.22 of its
        letters are edited, each edit touching three pairs of neighbours at most, or it is abbreviated.
        So a word with fewer than a third of its pairs in common is left out without loss.
        """
        got = self.near.get(word)
        if got is None:
            if len(self.near) > 200_000:
                self.near.clear()
            shared: Counter[str] = Counter()
            for g in pairs_of(word):
                shared.update(self.grams.get(g, ()))
            alike_ = {w for w, n in shared.items() if n >= 1 + 0.34 * max(len(w), len(word)) - 2}
            begun = {w for start in {word[:2], fold(word)[:2], word} for w in self.starts.get(start, ())}
            got = self.near[word] = frozenset(i for w in alike_ | begun for i in self.holders[w])
        return got

    def mentions(self, text: str) -> list[int]:
        """The entries of the longest mentions that stand at word boundaries and don't overlap, the best first."""
        found = []
        for end, (n, i) in self.automaton.iter(text) if self.entries else ():
            start = end + 1 - n
            if not (start and text[start - 1].isalnum()) and not (end + 1 < len(text) and text[end + 1].isalnum()):
                found.append((-n, start, end, i))
        out: list[tuple[bool, int, int, int, int]] = []
        for n, start, end, i in sorted(found):
            if all(end < s or start > e for _, _, s, e, _ in out):
                out.append((text[start : end + 1] in COMPANY, n, start, end, i))
        return [x[-1] for x in sorted(out)]

    def similar(self, text: str) -> tuple[float, int]:
        """(similarity, id) of the entry nearest by its words, or as a whole."""
        words = [(m[1], bool(m[2])) for m in re.finditer(r"([\w|!$’']+)(\.?)", text) if m[1] not in EMPTY]
        whole, best = squeeze(re.sub(r"\b(?:and|&)\b", "and", text)), (0.0, 0)
        for i in sorted(self.candidates(whole).union(*(self.candidates(w) for w, _ in words))):
            name, short = self.by_id[i]
            score = max(self._by_words(words, self.words[i], short), alike(whole, squeeze(name)) - 0.02)
            if score > best[0]:
                best = score, i
        return best

    def _by_words(self, words: list[tuple[str, bool]], wanted: list[str], short: str) -> float:
        if not words or not wanted:
            return 0.0
        free, total = list(words), 0.0
        for w in wanted:
            scored = [(self._word(g, dot, w), k) for k, (g, dot) in enumerate(free)]
            if not scored:
                return 0.0
            s, k = max(scored)
            if s < 0.62:
                return 0.0
            total += s
            free.pop(k)
        extra = [g for g, _ in free if g not in COMPANY and g.strip("()") != short and not g.isdigit()]
        return total / (len(wanted) + 0.55 * len(extra))

    def _word(self, got: str, dot: bool, want: str) -> float:
        if got == want or got == want + "s" or got + "s" == want or SHORT_WORDS.get(got) == want:
            return 1.0
        for g, w in ((got, want), (fold(got), fold(want))):
            if len(g) >= (2 if dot else 3) and len(g) < len(w) and w.startswith(g):
                return 0.95 if dot else 0.9
        s = alike(got, want)
        return s if len(want) > 3 or s == 1.0 else 0.0

    def match(self, value: str) -> tuple[int, float, str, list[int]]:
        """(id or 0, similarity, pass that decided, entries mentioned)."""
        text = bare(value)
        every = self.mentions(text)
        return *self._decided(text, every[0] if every else None), every

    def _decided(self, text: str, named: int | None) -> tuple[int, float, str]:
        if named is not None and text in self.automaton:
            return named, 1.0, "mention"
        score, i = self.similar(text)
        if named is not None and (score < LEAST or i == named or not set(self.words[named]) < set(self.words[i])):
            return named, 1.0, "mention"  # unless the value is nearer to a name of which the mention is a part
        return (i, score, "similar") if score >= LEAST else (0, score, "none")


def assign(values: DataFrame, key: str, value: str, entries: DataFrame) -> DataFrame:
    """``key``, ``value``, entry_id, score, pass, mentions array<int> for each row with a non-blank value."""
    wanted = entries.select("section_id", "section_name", "short_form").where("section_id is not null").distinct()
    listed = [(r[0], r[1], r[2]) for r in wanted.limit(MOST_ENTRIES + 1).collect()]
    if len(listed) > MOST_ENTRIES:
        raise ValueError(f"a list of more than {MOST_ENTRIES} entries")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, known = Canon(listed), {}
        for batch in batches:
            out = []
            for v in batch["v"]:
                if v not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[v] = canon.match(v)
                out.append(known[v])
            yield pd.DataFrame({"k": batch["k"], "v": batch["v"], "entry_id": [o[0] for o in out], "score": [o[1] for o in out], "pass": [o[2] for o in out], "mentions": [o[3] for o in out]})

    kind = values.schema[key].dataType.simpleString()
    rows = delivered_once(values.select(F.col(key).alias("k"), F.col(value).alias("v")).where(r"v rlike '[^\\s\\u00a0]'"), "k")
    # matching is slow for its few bytes, so tasks are many; by key, as one value may hold a third of all rows
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * values.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, F.xxhash64("k")).mapInPandas(run, f"k {kind}, v string, entry_id int, score double, pass string, mentions array<int>").withColumnsRenamed({"k": key, "v": value})


def unmatched(values: DataFrame, key: str, value: str, entries: DataFrame) -> DataFrame:
    """Each value that names no entry, with the number of rows that hold it."""
    got = assign(values, key, value, entries).where("entry_id = 0")
    return got.groupBy(value).agg(F.count(F.lit(1)).alias("n_rows"), F.max("score").alias("nearest"))
