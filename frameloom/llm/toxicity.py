r"""Toxicity by weak supervision.

Voters look at the whole text: words of a lexicon (in four strata by strength), words that begin with a stem (a
voter for each length), fixed insults, and five patterns (shouting, loud punctuation, drawn-out words, insults
disguised by digits or signs, insults aimed at the reader). The lexicon and the stems are mined from all labelled
rows, by the log odds of the documents that hold a word or a word's first letters: counted over toxic documents
first, then over all for what is frequent enough there. One pass over all texts notes which entries occur and which
voters fire. A generative label model then estimates, by expectation maximisation over the counts of vote patterns
of all documents and of the labelled ones, the classes' shares, how often each voter fires on either class, and how
voters depend on each other: within a class a voter depends on the one it shares most information with, along a
tree of greatest mutual information. Its posterior labels train a linear classifier over the entries, on a bounded
sample, and that scores every document.

Bounds, all parameters: ``SAMPLE`` rows for the classifier, ``ENTRIES`` of the strongest lexicon entries and stems
(the vocabulary of what is broadcast), 2 ** VOTERS vote patterns that reach the driver.

Edge cases: null and empty texts hold no entry and get the score of such a text; several labels of one id count as
toxic if one is; null labels are none; without labels only the fixed lexicon and the patterns vote; repeated rows
each get a row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import id_remainder, small_batches, text_groups, written

SAMPLE, ENTRIES = 12_000, 1 << 17
STRATA = 4
STEMS = range(4, 9)
PATTERNS = ("shouting", "loud", "drawn", "disguised", "aimed")
#: Voters by bit: strata of words, stems by length, fixed insults, patterns.
FIXED_VOTER = STRATA + len(STEMS)
VOTERS = FIXED_VOTER + 1 + len(PATTERNS)
#: A mined entry's log odds, and the nats by which its documents' share of toxic ones beats chance (so that
#: of a million words about five get in by luck).
LEAST_ODDS, LEAST_NATS, LEAST_DOCS = 2.0, 12.0, 3
#: Share of the toxic documents that a mined entry must stand in, so that what is counted grows with the documents only.
LEAST_SHARE = 1 / 400
#: Words that a task counts before it hands the counts on, and hash buckets of ids and entries that pass a filter.
HELD, BUCKETS = 400_000, 1 << 20
PRIOR = 0.1
#: Least part of a voter's entropy within classes that another must tell for the two to be joined.
LEAST_SHARED = 0.1
EDGES = ".,;:!?\"'()[]{}<>|#$%&*…«»“”-_/\\"
LOUD = re.compile("!{2,}|[?!]{3,}")
DRAWN = re.compile(r"([^\W\d_])\1\1")
#: Letters that digits and signs stand for, and words for the reader in four languages.
DISGUISE = str.maketrans("0134578@$!|", "oieastbasil")
READER = frozenset("you your youre you're u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre vos tú usted eres tus vosotros".split())
#: Insults in four languages, lower case.
FIXED = """
idiot moron stupid loser trash scum pathetic worthless disgusting clown dumbass imbecile scumbag
dummkopf trottel vollidiot abschaum arschloch versager widerlich
imbécile crétin abruti connard salaud minable ordure débile
imbécil estúpido basura escoria asqueroso payaso cretino tarado
""".split()


def words_of(text: str | None) -> set[str]:
    return {w.strip(EDGES) for w in set(text.lower().split())} - {""} if text else set()


def candidates(words: set[str]) -> set[str]:
    """Words, and stems (marked by a *) of longer ones."""
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Lexicon:
    """Entries by number; stems end with *. voter: bits of the voters each belongs to."""

    entries: list[str]
    words: dict[str, int] = field(init=False)
    stems: dict[str, int] = field(init=False)
    roots: set[str] = field(init=False)

    def __post_init__(self):
        self.words = {e: i for i, e in enumerate(self.entries) if not e.endswith("*")}
        self.stems = {e[:-1]: i for i, e in enumerate(self.entries) if e.endswith("*")}
        self.roots = {s[: STEMS[0]] for s in self.stems}
        fixed, mined, self.voter = set(FIXED), 0, []
        n = max(1, sum(e not in fixed for e in self.words))
        for e in self.entries:
            if e.endswith("*"):
                self.voter.append(1 << STRATA + len(e) - 1 - STEMS[0])
            elif e in fixed:
                self.voter.append(1 << FIXED_VOTER)
            else:  # entries come in order of strength
                self.voter.append(1 << mined * STRATA // n)
                mined += 1

    def held(self, text: str | None) -> list[int]:
        """Numbers of the entries in the text."""
        return self._held(words_of(text))

    def _held(self, words: set[str]) -> list[int]:
        found = set()
        for w in words:
            i = self.words.get(w)
            if i is not None:
                found.add(i)
            if w[: STEMS[0]] in self.roots:
                found.update(self.stems[w[:k]] for k in STEMS if len(w) > k and w[:k] in self.stems)
        return sorted(found)

    def _aimed(self, text: str) -> bool:
        """Whether a word of the lexicon stands within three words of one for the reader."""
        words = [w.strip(EDGES) for w in text.lower().split()]
        near = {i + d for i, w in enumerate(words) if w in READER for d in range(-3, 4)}
        return any(0 <= i < len(words) and words[i] in self.words for i in near)

    def judged(self, text: str | None) -> tuple[list[int], int]:
        """Numbers of the entries in the text, and the voters that fire as bits."""
        words = words_of(text)
        held, bits = self._held(words), 0
        for i in held:
            bits |= self.voter[i]
        if text:
            plain = " ".join(words)
            fires = (
                text.isupper() and sum(map(str.isalpha, text)) > 20,
                len(LOUD.findall(text)) > 2,
                DRAWN.search(plain) is not None,
                any(not w.isalpha() and (x := w.translate(DISGUISE)) != w and x in self.words for w in words),
                bool(held) and not words.isdisjoint(READER) and self._aimed(text),
            )
            for j, fire in enumerate(fires, FIXED_VOTER + 1):
                bits |= fire << j
        return held, bits


def buckets(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int")


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text and toxic of every labelled document."""
    own = labels.filter("toxic IS NOT NULL").groupBy(F.col(id_col).alias("__id")).agg((F.max("toxic") > 0).alias("toxic"))
    some = F.broadcast(own.select(buckets("__id").alias("bucket")).distinct())  # at most BUCKETS rows; the rest needs no shuffle
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).filter(F.col("__id").isNotNull())
    return texts.join(some, buckets("__id") == F.col("bucket"), "left_semi").join(own.hint("merge"), "__id").select("text", "toxic")


def entry_counts(texts: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """entry and n (texts that hold it), of all entries or of those in the wanted hash buckets."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter()

        def flush():
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["entry", "n"])
            held.clear()

        for _, texts in text_groups(batches):
            for text in texts:
                own = candidates(words_of(text))
                held.update(own if shared.value is None else [e for e in own if shared.value[bucket_of(e)]])
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return small_batches(texts.select("text")).mapInArrow(rows, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def bucket_of(entry: str) -> int:
    return zlib.crc32(entry.encode("utf-8", "surrogatepass")) % BUCKETS


def mine(learned: DataFrame, entries: int = ENTRIES) -> Lexicon:
    """The fixed entries, and those whose documents' odds of being toxic stand out, the strongest first."""
    size = {r.toxic: r.n for r in learned.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, q = size.get(True, 0), size.get(False, 0)
    if not p:
        return Lexicon(list(FIXED))
    # What stands in fewer toxic documents can't reach LEAST_NATS, even without any clean one.
    least = max(LEAST_DOCS, LEAST_SHARE * p, LEAST_NATS / math.log((p + q) / p) if q else 0)
    often = written(entry_counts(learned.filter("toxic")).filter(F.col("n") >= least), "toxic-entries")
    wanted = np.zeros(BUCKETS, bool)
    at = often.select((F.crc32(F.col("entry").cast("binary")) % BUCKETS).cast("int").alias("b")).distinct()  # at most BUCKETS rows
    wanted[[r.b for r in at.collect()]] = True
    clean = entry_counts(learned.filter("NOT toxic"), wanted).withColumnRenamed("n", "b")
    counted = often.withColumnRenamed("n", "a").join(clean, "entry", "left").withColumn("b", F.coalesce("b", F.lit(0))).withColumn("n", F.col("a") + F.col("b"))
    odds = F.log((F.col("a") + 0.5) / (p - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (q - F.col("b") + 0.5))
    plain = lambda x, share: F.when(x > 0, x * F.log(x / F.col("n") / share)).otherwise(0.0)
    nats = plain(F.col("a"), p / (p + q)) + (plain(F.col("b"), q / (p + q)) if q else F.lit(0.0))
    best = counted.withColumns({"odds": odds, "nats": nats}).filter((F.col("odds") >= LEAST_ODDS) & (F.col("nats") >= LEAST_NATS)).orderBy(F.desc("nats"), "entry").limit(entries).select("entry")
    return Lexicon(list(dict.fromkeys([*FIXED, *(r.entry for r in best.collect())])))


def marked(docs: DataFrame, lexicon: Lexicon, keep: list[str], text_col: str) -> DataFrame:
    """The columns keep with held (numbers of the entries in the text) and votes."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part, texts in text_groups(batches, "__text"):
            held, votes = zip(*map(own.judged, texts), strict=True) if texts else ([], [])
            yield pa.record_batch([*(part.column(c) for c in keep), pa.array(held, pa.list_(pa.int32())), pa.array(votes, pa.int32())], names=[*keep, "held", "votes"])

    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return small_batches(own).mapInArrow(rows, f"{schema}, held array<int>, votes int")


def votes_of(patterns: np.ndarray) -> np.ndarray:
    return np.asarray(patterns, np.int64)[:, None] >> np.arange(VOTERS) & 1


class LabelModel:
    """P(toxic | votes) from the counts of vote patterns: of each class a tree in which a voter depends on one other."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray, rounds: int = 3, steps: int = 20):
        """counts of the patterns over all documents, and known (clean and toxic, by pattern): those of the labelled ones."""
        votes = votes_of(patterns)
        self.parents = np.full(VOTERS, -1)
        self.correlations = np.zeros((VOTERS, VOTERS))
        # Without labels a voter is taken to fire on a third of toxic and one in a hundred clean documents.
        anchor = known * max(1.0, counts.sum() / max(1.0, known.sum())) if known.min(initial=0) >= 0 and known.sum(1).min() > 0 else np.zeros_like(known)
        self.prior = PRIOR if not anchor.sum() else float(anchor[1].sum() / anchor.sum())
        start = np.array([[0.01], [0.3]]) * np.ones(VOTERS)
        self._base = (anchor @ votes + 2 * start) / (anchor.sum(1, keepdims=True) + 2)
        self.table = np.repeat(self._base[:, :, None], 2, 2)
        for _ in range(rounds if len(patterns) else 0):
            for _ in range(steps):
                toxic = self._posterior(votes)
                mass = np.stack([counts * (1 - toxic), counts * toxic]) + anchor
                self._estimate(votes, mass)
            self._grow(votes, mass)
            self._estimate(votes, mass)

    def _estimate(self, votes: np.ndarray, mass: np.ndarray) -> None:
        """Rates of each voter, given its parent's vote: table[class, voter, vote of the parent]."""
        self.prior = float(((mass[1].sum() + 2 * PRIOR) / (mass.sum() + 2)).clip(1e-4, 1 - 1e-4))
        rates = (mass @ votes + 2 * self._base) / (mass.sum(1, keepdims=True) + 2)
        for j, parent in enumerate(self.parents):
            above = votes[:, parent] if parent >= 0 else np.zeros(len(votes), np.int64)
            for v in (0, 1):
                own = mass * (above == v)
                self.table[:, j, v] = (own @ votes[:, j] + 2 * rates[:, j]) / (own.sum(1) + 2)
        self.rates = rates
        self.table = self.table.clip(1e-5, 1 - 1e-5)

    def _grow(self, votes: np.ndarray, mass: np.ndarray) -> None:
        """Each voter's parent, along the tree of greatest mutual information within classes."""
        shared, total = np.zeros((VOTERS, VOTERS)), mass.sum()
        least = np.zeros((VOTERS, VOTERS))
        self.correlations = np.zeros((VOTERS, VOTERS))
        for own in mass:
            n = own.sum() + 1e-9
            both = {(a, b): ((votes == a) * own[:, None]).T @ (votes == b) / n for a in (0, 1) for b in (0, 1)}
            one = {a: own @ (votes == a) / n for a in (0, 1)}
            for (a, b), p in both.items():
                free = np.outer(one[a], one[b])
                shared += n / total * np.where(p > 1e-12, p * np.log(p.clip(1e-12) / free.clip(1e-12)), 0)
            doubt = -sum(one[a] * np.log(one[a].clip(1e-12)) for a in (0, 1))
            least += n / total * np.minimum.outer(doubt, doubt)
            spread = np.sqrt((one[0] * one[1]).clip(1e-9))
            self.correlations = np.maximum(self.correlations, (both[1, 1] - np.outer(one[1], one[1])) / np.outer(spread, spread))
        np.fill_diagonal(self.correlations, 0)
        self.parents = np.full(VOTERS, -1)
        shared = np.where(shared >= LEAST_SHARED * least, shared, 0)
        best, parent, todo = shared[0].copy(), np.zeros(VOTERS, int), set(range(1, VOTERS))
        while todo:
            j = max(sorted(todo), key=lambda x: best[x])
            todo.remove(j)
            self.parents[j] = parent[j] if best[j] > 0 else -1
            closer = shared[j] > best
            best, parent = np.where(closer, shared[j], best), np.where(closer, j, parent)

    def _posterior(self, votes: np.ndarray) -> np.ndarray:
        above = np.where(self.parents >= 0, votes[:, self.parents], 0)
        fires = self.table[:, np.arange(VOTERS), above]  # class, pattern, voter
        logs = np.log(np.where(votes, fires, 1 - fires)).sum(2)
        odds = np.log(self.prior / (1 - self.prior)) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-odds.clip(-60, 60)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(votes_of(patterns))


def fit_linear(held: list[np.ndarray], target: np.ndarray, size: int, steps: int = 400, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over entry numbers, the bias last, by Adam on the whole sample."""
    at = np.repeat(np.arange(len(held)), [len(h) for h in held])
    which = np.concatenate([*held, np.zeros(0, np.int64)]).astype(np.int64)
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        odds = w[-1] + np.bincount(at, w[which], len(held))
        error = 1 / (1 + np.exp(-odds.clip(-60, 60))) - target
        grad = np.append(np.bincount(which, error[at], size), error.sum()) / max(1, len(held)) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, entries: int = ENTRIES) -> DataFrame:
    """The columns keep of docs with score (0 to 1) and n_votes (voters that fire). Only labels handed in are learned from."""
    learned = written(labelled(docs, labels, id_col, text_col), "labelled")
    lexicon = mine(learned, entries)
    seen = marked(learned, lexicon, ["toxic"], "text").groupBy("toxic", "votes").agg(F.count("*").alias("n")).collect()  # 2 ** (VOTERS + 1) rows at most
    found = written(marked(docs, lexicon, keep, text_col), "marked")
    patterns = found.groupBy("votes").agg(F.count("*").alias("n")).toPandas()
    at = {v: i for i, v in enumerate(patterns["votes"])}
    known = np.zeros((2, len(patterns)))
    for r in seen:
        known[int(r.toxic), at[r.votes]] += r.n
    model = LabelModel(patterns["votes"].to_numpy(np.int64), patterns["n"].to_numpy(float), known)
    total = int(patterns["n"].sum())
    some = found.select("held", "votes").filter(F.pmod(F.xxhash64(F.col(keep[0])), F.lit(max(1, -(-total // sample)))) == 0).toPandas()
    target = model.posterior(some["votes"].to_numpy(np.int64)) if len(some) else np.zeros(0)
    shared = docs.sparkSession.sparkContext.broadcast(fit_linear(list(some["held"]), target, len(lexicon.entries)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            held = batch.column("held")
            sizes = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
            odds = w[-1] + np.bincount(np.repeat(np.arange(len(sizes)), sizes), w[held.flatten().to_numpy(zero_copy_only=False)], len(sizes))
            score = 1 / (1 + np.exp(-odds.clip(-60, 60)))
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(score), pa.array(np.bitwise_count(batch.column("votes").to_numpy()).astype(np.int32))], names=[*keep, "score", "n_votes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields if f.name in keep)
    return found.mapInArrow(rows, f"{schema}, score double, n_votes int")


def toxicity_by_id(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and n_votes, learned from labels of ids whose crc32 is not 0 modulo 5."""
    return toxicity(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0), ["doc_id"])
