"""Texts cut by a field limit or in transfer.

A source is a field of an engine. For each source the lengths are fitted by a log-normal
distribution by maximum likelihood, with the values at a candidate limit right-censored. A
candidate is a length at which values pile up against their neighbourhood. A value's censoring
posterior is the share of the values at its length that the fitted density can't account for.

What an ending says is learnt from these posteriors: endings fall into kinds (a mark, a sentence
end, an unfinished word, last words after which captions end so or so often, ...), and an EM over
all texts fits how often each kind stands at the end of cut and of complete texts, and how many
texts each source loses in transfer. The values at the limits, cut almost for sure, and the texts
whose end is marked as cut anchor it; pseudo-counts (``ENDINGS``) say what a kind means where nothing is counted. A text is cut if
prior and ending together make that likelier than not, and it doesn't stop at a sentence end.

Contexts of last words are counted over all captions and joined, never collected. Running
headers, page numbers and marks behind the text are set aside first. Null, empty and blank texts
and bare labels ("Table 3") are no cases. Repeated deliveries count once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridquill.functions.units import DEGREES, si, tidy
from gridquill.llm.noise import Lexicon, Repair, forms_of, header_lines, texts, with_headers
from gridquill.session import settled

#: Weight of the prior for the rate of texts cut in transfer: so many cut among so many texts.
LOST = (1.0, 50.0)
#: Words of context, and occurrences from which a context is trusted.
WORDS, TRUSTED = 4, 20
#: Least share of all words of a caption for one that goes to every worker (so at most 1 / SHARE do).
SHARE = 2e-6
#: A word is whole if it stands within texts at least so often, against the longer words that it begins.
WHOLE = 0.02
#: A candidate limit holds at least so many values, so many times its neighbourhood.
PILE, TIMES = 5, 6.0
#: Kinds of endings and the pseudo-counts of complete and of cut texts with which each enters the fit.
ENDINGS = {
    "mark": (0.01, 5.0), "closed": (500.0, 0.2), "abbreviated": (0.02, 20.0), "number": (20.0, 1.0), "open": (0.01, 20.0), "hanging": (0.01, 10.0), "bracket open": (0.01, 10.0), "bracket": (20.0, 0.3), "citation": (20.0, 0.3), "unit": (20.0, 0.3),
    "letter": (0.05, 5.0), "unfinished": (0.02, 10.0), "unknown": (5.0, 1.0), "compound": (5.0, 1.0), **{f"ends 2^-{k}": (250 * 2.0**-k, 4.0) for k in range(12)},
}
#: Endings with which no text is complete.
CERTAIN = ("mark", "abbreviated")
BARE_LABEL = re.compile(r"\W*(?:table|tab|scheme|fig|figure)\.?\s*[A-Z]?\d*[\W]*", re.I)
MARK = re.compile(r"\s*(?:\[\s*truncated\s*\]|\(\s*truncated\s*\)|…|\.\.\.+|�+|\[\s*(?:…|\.\.\.)\s*\]|[¬­‐]|\[cut\]|<truncated>|>>)\s*$", re.I)
CLOSED = re.compile(r"[.!?][”’\"')\]]*\s*$")
ABBREVIATED = re.compile(r"(?:\b(?:fig|tab|figs|eq|ref|refs|no|vs|ca|cf|approx|et al|e\.g|i\.e)|\b[a-z]\.[a-z])\.$", re.I)
NUMBER_END = re.compile(r"(?:^|\s)[<>~±(]*\d+\.$")
DIVISION = re.compile(r"(?<=[^\W\d_])[-¬\u00ad‐‑](?:[ \t]*\r?\n\s*|[ \t]+)(?=[a-z])(?!and\b)")
TOKEN = re.compile(r"<ref>|[^\W_](?:[^\W_]|[-/^+%·|!$](?=[^\W_]))*[%]?|#[^\W_]*|[°µμ]\w*|[,;:.()]")


def tokens(text: str) -> list[str]:
    """Lower-case words and punctuation, numbers masked, divided words put together."""
    text = DIVISION.sub("", text)
    text = re.sub(r"\[[\d,;\s–-]+\]", " <ref> ", text.lower())
    return TOKEN.findall(re.sub(r"(?<![a-z\d/])\d+(?:[.,]\d+)*", "#", text))


def contexts(captions: list[str]) -> dict[str, list[int]]:
    """Of each run of up to ``WORDS`` words: occurrences, those before punctuation, those that end a text."""
    out: dict[str, list[int]] = {}
    for text in captions:
        marked = bool(MARK.search(text))
        t = tokens(text)
        for i, word in enumerate(t):
            if word in ",;:.()":
                continue
            last = i + 1 == len(t)
            if last and marked:
                continue
            phrase = not last and t[i + 1] in ";.("
            for n in range(1, WORDS + 1):
                if i + 1 < n:
                    break
                cell = out.setdefault(" ".join(t[i + 1 - n : i + 1]), [0, 0, 0])
                cell[0] += 1
                cell[1] += phrase
                cell[2] += last
    return out


def censored_fit(lengths: np.ndarray, counts: np.ndarray, censored: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood (EM), some lengths right-censored."""
    x = np.log(np.maximum(lengths, 1).astype(float))
    w = counts.astype(float)
    mean = float(np.average(x, weights=w))
    dev = max(float(np.sqrt(np.average((x - mean) ** 2, weights=w))), 0.05)
    for _ in range(60):
        z = (x - mean) / dev
        tail = np.array([max(0.5 * math.erfc(v / math.sqrt(2)), 1e-12) for v in z])
        mills = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        first = np.where(censored, mean + dev * mills, x)
        second = np.where(censored, mean**2 + dev**2 + dev * (x + mean) * mills, x * x)
        new = float(np.average(first, weights=w))
        new_dev = max(math.sqrt(max(float(np.average(second, weights=w)) - new**2, 1e-6)), 0.05)
        done = abs(new - mean) + abs(new_dev - dev) < 1e-6
        mean, dev = new, new_dev
        if done:
            break
    return mean, dev


def limits(lengths: np.ndarray, counts: np.ndarray, ended: np.ndarray | None = None) -> dict[int, float]:
    """Censoring posterior by length, for the lengths at which values pile up.

    ``ended`` has how many of the values at each length stop at a sentence end: these count for
    the distribution of lengths, but are never censored.
    """
    if not len(lengths):
        return {}
    open_ = counts if ended is None else counts - ended
    by = dict(zip(lengths.tolist(), open_.tolist(), strict=True))
    total = float(open_.sum())
    piles = []
    for n in by:
        near = [by.get(n + d, 0) for d in (*range(-30, -2), *range(3, 31))]
        usual = max(sum(near) / len(near), 0.3)
        if by[n] >= PILE and by[n] > TIMES * usual and (by[n] - usual) / math.sqrt(usual) > 6:
            piles.append(n)
    out: dict[int, float] = {}
    for n in piles:
        at = np.isin(lengths, [n - 1, n])
        values = [(lengths, open_, at)] if ended is None else [(lengths, open_, at), (lengths, ended, np.zeros(len(lengths), bool))]
        mean, dev = censored_fit(*map(np.concatenate, zip(*values, strict=True)))
        for m in (n, n - 1):
            if by.get(m):
                z = (math.log(max(m, 1)) - mean) / dev
                expected = total * math.exp(-0.5 * z * z) / (math.sqrt(2 * math.pi) * dev * max(m, 1))
                near = [by.get(m + d, 0) for d in range(-20, -2)]
                expected = max(min(expected, by[m]), sum(near) / len(near) if near else 0.0, 0.02)
                out[m] = max(out.get(m, 0.0), 1 - min(expected / by[m], 1.0))
    return out


class Endings:
    """The kind of a text's ending, from the words of all captions."""

    def __init__(self, table: dict[str, tuple[int, int]]):
        self.table = table  # word -> occurrences, those at the end of a text
        self.lexicon = Lexicon({w: n for w, (n, _) in table.items() if w.isalpha()})
        self.heads: dict[str, int] = {}  # beginnings of words -> occurrences of the most frequent
        for word, (n, _) in table.items():
            for part in {word, *re.split(r"[-/]", word)}:
                for k in range(1, len(part)):
                    if n > self.heads.get(part[:k], 0):
                        self.heads[part[:k]] = n

    def _phrase(self, text: str) -> tuple[str | None, list[str]]:
        """(kind, []) of a text without a full stop, or (None, its last words, longest run first) where the contexts decide."""
        t = tokens(text)
        if not t or t[-1] in ",;:(" or re.search(r"[-–/&=<>(,;:±×]\s*$", text):
            return "hanging", []
        if t[-1] == ")":
            return "bracket", []
        if text.count("(") > text.count(")"):
            return "bracket open", []
        if t[-1] == "<ref>":
            return "citation", []
        if text.count("[") > text.count("]"):
            return "bracket open", []
        stated = re.search(r"(?:\bin|:) ([^.:;,]{1,24})$", text.rstrip())
        if stated and (si(stated[1]) is not None or tidy(stated[1]) in DEGREES):
            return "unit", []  # as in "band gap in eV"
        last = t[-1]
        if len(last) == 1 and last.isalpha() and len(t) > 1 and t[-2].isalpha() and t[-2] not in ("in", "parameter"):
            return "letter", []  # and no unit after a number
        t[-WORDS:] = [(self.lexicon.neighbours(w) or [w])[0] for w in t[-WORDS:]]
        last = t[-1]
        if self._whole(last):
            return None, [" ".join(t[-n:]) for n in range(min(WORDS, len(t)), 0, -1)]
        parts = re.split(r"[-/]", last)
        if len(parts) > 1 and all(map(self._whole, parts)):
            return "compound", []
        return "unfinished" if parts[-1] in self.heads else "unknown", []

    def _whole(self, word: str) -> bool:
        """Seen within texts; a word at the end of one may be unfinished."""
        n, finals = self.table.get(word, (0, 0))
        within = n - finals
        if word.isalpha() and within < max(2.0, WHOLE * self.heads.get(word, 0)) and word in self.heads:
            return False  # rare against the words that go on from it
        return within > 0 and finals <= 20 * within

    def kind(self, field: str, text: str) -> tuple[str | None, list[str]]:
        text = text.rstrip()
        if not text.strip() or BARE_LABEL.fullmatch(text.strip()):
            return "label", []
        if MARK.search(text):
            return "mark", []
        if CLOSED.search(text):
            return "abbreviated" if ABBREVIATED.search(text) else "number" if NUMBER_END.search(text) else "closed", []
        if field == "caption":
            return self._phrase(text)
        last = tokens(text[-80:])
        return "unfinished" if last and last[-1].isalpha() and last[-1] in self.heads and not self._whole(last[-1]) else "open", []


def endings_fit(counts: list[tuple[str, str | None, float, str, int]]) -> tuple[dict[tuple[str, str], float], dict[tuple[str, str | None], float]]:
    """Log odds for a cut by (field, kind), and rate of texts lost in transfer by (field, engine).

    ``counts`` has field, engine, censoring posterior, kind, texts. EM over two classes: cut with
    the prior 1 - (1 - posterior)(1 - rate of the source), else complete; what ends with a mark or an abbreviation is cut.
    """
    odds: dict[tuple[str, str], float] = {}
    lost: dict[tuple[str, str | None], float] = {}
    kinds = {k: i for i, k in enumerate(ENDINGS)}
    for field in {c[0] for c in counts}:
        own = [c for c in counts if c[0] == field and c[3] in kinds]
        engines = {e: i for i, e in enumerate(dict.fromkeys(c[1] for c in own))}
        at, kind = np.array([engines[c[1]] for c in own], int), np.array([kinds[c[3]] for c in own], int)
        p, n = np.array([c[2] for c in own], float), np.array([c[4] for c in own], float)
        pseudo = np.array(list(ENDINGS.values()))
        rate = np.full(len(engines), LOST[0] / LOST[1])
        theta = pseudo / pseudo.sum(0)
        free, certain = p == 0, np.isin(kind, [kinds[k] for k in CERTAIN])
        for _ in range(500):
            prior = 1 - (1 - p) * (1 - rate[at])
            cut = prior * theta[kind, 1]
            z = np.where(certain, 1.0, cut / (cut + (1 - prior) * theta[kind, 0]))
            new = np.stack([np.bincount(kind, n * w, len(kinds)) for w in (1 - z, z)], 1) + pseudo
            new /= new.sum(0)
            rate = (np.bincount(at[free], (n * z)[free], len(engines)) + LOST[0]) / (np.bincount(at[free], n[free], len(engines)) + LOST[1])
            done = np.abs(new - theta).max() < 1e-7
            theta = new
            if done:
                break
        odds |= {(field, k): float(math.log(theta[i, 1] / theta[i, 0])) for k, i in kinds.items()}
        lost |= {(field, e): float(rate[i]) for e, i in engines.items()}
    return odds, lost


def classified(items: DataFrame, pages: DataFrame) -> DataFrame:
    """field, item_id, engine, n_chars, text_hash, kind of ending: one row per text."""
    spark = items.sparkSession

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = contexts(batch["text"].tolist())
            yield pd.DataFrame({"w": list(got)} | {c: [v[i] for v in got.values()] for i, c in enumerate("npe")})

    captions = items.where("field = 'caption'").select("text")
    whole = settled(captions.mapInPandas(count, "w string, n bigint, p bigint, e bigint").groupBy("w").agg(*[F.sum(c).alias(c) for c in "npe"]))
    words = whole.where("not contains(w, ' ')")
    total = words.agg(F.sum("n")).first()[0] or 0
    table = {r["w"]: (r["n"], r["e"]) for r in words.where(F.col("n") >= max(2, SHARE * total)).select("w", "n", "e").collect()}  # at most 1 / SHARE words
    lines = settled(header_lines(pages))
    shared = spark.sparkContext.broadcast((table, forms_of(lines)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, forms = shared.value
        endings, clean = Endings(table), Repair(Lexicon({}), forms)
        for batch in batches:
            rows = []
            for field, item, engine, text, headers in zip(*(batch[c] for c in ("field", "item_id", "engine", "text", "headers")), strict=True):
                bare, _ = clean.header(text.replace("\r\n", "\n"), () if headers is None else headers)
                bare, _ = clean.page_number(bare)
                kind, runs = endings.kind(field, bare)
                rows.append((field, item, engine, len(text), kind, runs))
            out = pd.DataFrame(rows, columns=["field", "item_id", "engine", "n_chars", "kind", "runs"])
            yield out.assign(text_hash=batch["text_hash"].to_numpy())

    joined = with_headers(items, lines).select("field", "item_id", "engine", "text", "headers", F.xxhash64("text").alias("text_hash"))
    first = settled(joined.mapInPandas(judge, "field string, item_id bigint, engine string, n_chars int, kind string, runs array<string>, text_hash bigint"))
    # how often texts end or pause after the same last words, the text in question apart; the longest trusted run counts
    seen, ends = F.col("n") - 1, F.col("p") + F.col("e") - 1
    sure = F.greatest(F.lit(0.0), ends - F.sqrt(F.greatest(ends, F.lit(0)).cast("double"))) / F.greatest(seen, F.lit(1))  # cut texts end there too
    bucket = F.concat(F.lit("ends 2^-"), F.least(F.lit(11), F.floor(-F.log2(sure + 5e-4))).cast("int").cast("string"))
    asked = first.where("kind is null").select("field", "item_id", F.posexplode("runs").alias("rank", "w"), F.size("runs").alias("size")).join(whole, "w")
    trusted = asked.where((seen >= TRUSTED) | (F.col("rank") == F.col("size") - 1))
    told = trusted.groupBy("field", "item_id").agg(F.min_by(bucket, "rank").alias("told"))
    return first.drop("runs").join(told, ["field", "item_id"], "left").select("field", "item_id", "engine", "n_chars", "text_hash", F.coalesce("kind", "told", F.lit("unknown")).alias("kind"))


def judged(tables: DataFrame, mentions: DataFrame, pages: DataFrame, fit_limits: bool = True) -> DataFrame:
    """field, item_id, engine, n_chars, kind, censored (posterior), cut_odds, cut boolean: one row per text.

    ``fit_limits`` switches the censored fit off, to measure what it does.
    """
    items = texts(tables, mentions).dropDuplicates(["field", "item_id"])
    every = settled(classified(items, pages))
    cells = every.groupBy("field", "engine", "n_chars", "kind").agg(F.count_distinct("text_hash").alias("n")).toPandas()  # sources x distinct lengths x kinds; copies of a text are no pile
    counts, prior = [], {}
    for (field, engine), group in cells[cells["kind"] != "label"].groupby(["field", "engine"], dropna=False):
        name = engine if isinstance(engine, str) else None
        by_length = group.assign(ended=group["n"].where(group["kind"].isin(["closed", "number"]), 0)).groupby("n_chars")[["n", "ended"]].sum()
        own = limits(by_length.index.to_numpy(), by_length["n"].to_numpy(), by_length["ended"].to_numpy()) if fit_limits else {}
        prior |= {(field, name, m): p for m, p in own.items()}
        counts += [(field, name, 0.0 if kind == "closed" else own.get(m, 0.0), kind, n) for m, kind, n in zip(group["n_chars"], group["kind"], group["n"], strict=True)]
    odds, lost = endings_fit(counts)
    spark = items.sparkSession
    at_limit = spark.createDataFrame([(f, e, int(m), float(p)) for (f, e, m), p in prior.items()], "field string, engine string, n_chars int, censored double")
    rate = spark.createDataFrame([(f, e, p) for (f, e), p in lost.items()], "field string, engine string, lost double")
    weight = spark.createDataFrame([(f, k, o) for (f, k), o in odds.items()], "field string, kind string, weight double")
    # limits, sources and kinds: a few rows each
    out = every
    for side, keys in ((at_limit, ["field", "engine", "n_chars"]), (rate, ["field", "engine"]), (weight, ["field", "kind"])):
        side = side.withColumnsRenamed({k: f"_{k}" for k in keys})
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        out = out.join(F.broadcast(side), on, "left").drop(*[f"_{k}" for k in keys])
    p = 1 - (1 - F.coalesce("censored", F.lit(0.0))) * (1 - F.coalesce("lost", F.lit(LOST[0] / LOST[1])))
    cut_odds = F.log(p / (1 - p + 1e-9)) + F.col("weight")
    out = out.select("field", "item_id", "engine", "n_chars", "kind", F.coalesce("censored", F.lit(0.0)).alias("censored"), cut_odds.alias("cut_odds"))
    likely = (F.col("cut_odds") > 0) & ~F.col("kind").isin("closed", "label")
    return out.withColumn("cut", F.coalesce(F.col("kind").isin(*CERTAIN) | likely, F.lit(False)))


def found(tables: DataFrame, mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """field, item_id of each cut text."""
    return judged(tables, mentions, pages).where("cut").select("field", "item_id")


def rates(tables: DataFrame, mentions: DataFrame, pages: DataFrame) -> DataFrame:
    """engine, field, n_texts, n_cut, share: how often each source truncates."""
    got = judged(tables, mentions, pages).groupBy("engine", "field").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return got.withColumn("share", F.col("n_cut") / F.col("n_texts"))
