"""Personal data in free text, found and replaced by typed placeholders (problem 1).

Weak supervision: regex, gazetteer and context labelers (pii_labelers.py)
propose spans that may overlap and vote on all of them. On a bounded sample of
rows expectation-maximisation estimates, for each kind, how common personal
spans are and what every vote of every labeler is worth, in either direction;
its soft labels train a final classifier of spans over votes, neighbouring
words and shapes. The classifier reads every row once, and of overlapping spans
those with the greatest sum of scores stay: it decides whether a span is
personal, how far it reaches and of which kind it is.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almanak.llm.pii_labelers import GIVEN, INITIAL, KINDS, LABELERS, OTHER, TITLES, Candidate, Labelers, last_word, levelled
from almanak.llm.screen import Screen

#: Rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4_000
#: Hashed features of words and shapes.
SPACE = 1 << 13
_VOTES = len(KINDS) * len(LABELERS) * 3

# Common given names, for archives whose structured fields name few people.
GIVEN_NAMES = """ann anna anne alice andrew anthony april arthur ben bryn carl charles chris clive colin dale daniel david dean edith edward ella emily emma eric faye frank george grace
hannah harry hazel helen henry hugh iris ivy jack james jane jean joan john joseph julia karen kate laura leo linda lorna lucy luke mabel margaret mark martha martin mary matthew michael miles nancy
nora olive oliver owen paul peter philip piers rachel ralph rhys richard robert rose ruth samuel sarah simon sophie stephen susan tess thomas tom victoria walter wendy will william
anja arne birgit dörte frauke gesine götz hans heike henning ilse jürgen käthe klaus lutz silke sören ursula uwe volker wiebke wolfgang
aurore benoît cédric élodie fabrice françois gaël hélène loïc maëlle margaux noémie odile régis solène thierry yannick
álvaro andrés begoña belén gonzalo hernán inés íñigo joaquín lucía marisol nuria pilar ramiro rocío ximena""".split()


class Gazetteer:
    """Given and family names, all of them, in a Bloom filter: at most 16 MB however many there are.

    Every name stands under two keys, so that a word that is no name passes
    with a chance below 1e-6 up to a million names.
    """

    def __init__(self, names: DataFrame):
        """``names``: ``kind`` (g or f) and ``name`` in small letters."""
        keys = names.select(F.explode(F.array(*[F.xxhash64(F.concat(F.lit(n), "kind", F.lit(":"), "name")) for n in "12"])).alias("key"))
        self.screen = Screen(keys.distinct(), bits=128)

    def holds(self, kind: str, name: str) -> bool:
        import xxhash

        keys = np.array([xxhash.xxh64(f"{n}{kind}:{name}".encode(), seed=42).intdigest() for n in "12"], np.uint64)
        return bool(self.screen(keys.view(np.int64)).all())


def names_known(events: DataFrame) -> DataFrame:
    """``kind``, ``name``: every given (g) and family (f) name that structured fields (organizers, attendees) hold, once."""
    people = events.select(F.explode(F.concat(F.array("organizer.name"), F.coalesce(F.transform("attendees", lambda a: a["name"]), F.array().cast("array<string>")))).alias("name"))
    name = F.regexp_replace(F.trim(F.translate("name", "\u00a0", " ")), r"\s(?:\p{L}\.\s?)+", " ")
    shape, turned = r"^(\p{L}{2,}(?:-\p{L}+)?) (\p{L}[\p{L}’'-]{2,})$", r"^(\p{L}[\p{L}’'-]{2,}), (\p{L}{2,}(?:-\p{L}+)?)$"
    pair = lambda given, family: F.array(F.struct(F.lit("g").alias("kind"), F.lower(given).alias("name")), F.struct(F.lit("f").alias("kind"), F.lower(family).alias("name")))
    both = F.when(name.rlike(shape), pair(F.regexp_extract(name, shape, 1), F.regexp_extract(name, shape, 2))).otherwise(pair(F.regexp_extract(name, turned, 2), F.regexp_extract(name, turned, 1)))
    return people.filter("name is not null").select(F.explode(both).alias("p")).select("p.kind", "p.name").filter("name <> ''").distinct()


def common_words(texts: list[str], labelers: Labelers) -> frozenset[str]:
    """Words of the sample that are no names: met in small letters, or with a capital mostly where no name is begun."""
    small = {w for t in texts for w in re.findall(r"(?<![\w@.+-])[^\W\d_A-Z][^\W\d_]*(?![\w@+-]|\.\w)", levelled(t)) if w.islower()}
    beside, apart = Counter(), Counter()
    for t in texts:
        t = levelled(t)
        words = labelers.words(t)
        for k, (a, _, w, c) in enumerate(words):
            if c == OTHER:
                named = k and words[k - 1][3] in (GIVEN, INITIAL) and a - words[k - 1][1] <= 2
                (beside if named or last_word(t, a) in TITLES else apart)[w.lower()] += 1
    return frozenset(small | {w for w, n in apart.items() if n > beside[w]})


def reliabilities(votes: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over votes (candidates x labelers) of one kind.

    Gives the probability that each candidate is personal, the weight of each
    labeler's votes against and for (log odds, of either sign: a labeler may
    turn out to be wrong more often than right), and the share of personal
    ones. Labelers are taken as independent given the truth and no opinion as
    no evidence; the first guess is the majority of votes, and half a
    pseudo-count keeps unseen votes possible.
    """
    p = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    n = votes.shape[1]
    places = votes + 1 + 3 * np.arange(n)
    weights = np.zeros((n, 3))
    for _ in range(rounds):
        yes = np.bincount(places.ravel(), weights=np.repeat(p, n), minlength=3 * n).reshape(n, 3) + 0.5
        no = np.bincount(places.ravel(), weights=np.repeat(1 - p, n), minlength=3 * n).reshape(n, 3) + 0.5
        weights = np.log(yes / yes.sum(1, keepdims=True)) - np.log(no / no.sum(1, keepdims=True))
        weights[:, 1] = 0.0
        prior = (p.sum() + 1) / (len(p) + 2)
        score = np.log(prior / (1 - prior)) + weights.ravel()[places].sum(1)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, weights[:, [0, 2]], float(prior)


def surroundings(text: str, c: Candidate) -> tuple[tuple[str, str], ...]:
    """The word before a candidate, the one after it, and its shape, each with a mark of what it is."""
    left = text[max(0, c.begin - 20) : c.begin].split()
    right = text[c.end : c.end + 20].split()
    return ("l", left[-1].lower() if left else ""), ("r", right[0].lower() if right else ""), ("s", text[c.begin : min(c.end, c.begin + 12)])


def _places(c: Candidate) -> list[int]:
    kind = KINDS.index(c.kind)
    return [(kind * len(LABELERS) + i) * 3 + v + 1 for i, v in enumerate(c.votes)]


def _place(kind: str, mark: str, x: str) -> int:
    if mark == "s":
        x = "".join("9" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else ch for ch in x)
    return _VOTES + crc32(f"{KINDS.index(kind)}{mark}{x}".encode()) % SPACE


def features(text: str, c: Candidate) -> list[int]:
    """Places of a candidate's features: votes by kind, the words beside it, and its shape."""
    return _places(c) + [_place(c.kind, mark, x) for mark, x in surroundings(text, c)]


def fit(active: np.ndarray, target: np.ndarray, start: np.ndarray, rounds: int = 300, rate: float = 0.05, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic classifier on soft labels, by Adam; rows of ``active`` are places of features.

    It sets out from ``start``, the estimated worth of the votes, and keeps
    that for votes that the sample does not show.
    """
    places, dense = np.unique(active, return_inverse=True)
    dense = dense.reshape(active.shape)
    w = start[places].copy()
    mean, square = np.zeros_like(w), np.zeros_like(w)
    n = len(target)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(w[dense].sum(1), -40, 40)))
        g = np.bincount(dense.ravel(), weights=np.repeat((p - target) / n, dense.shape[1]), minlength=len(w)) + decay * (w - start[places])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    weights = start.copy()
    weights[places] = w
    return weights


def best(found: list[tuple[float, Candidate]]) -> list[Candidate]:
    """Of overlapping candidates with positive scores the disjoint ones whose scores have the greatest sum; ties go to the longer."""
    found = sorted((x for x in found if x[0] > 0), key=lambda x: (x[1].end, x[1].begin))
    if all(a[1].end <= b[1].begin for a, b in zip(found, found[1:])):
        return [c for _, c in found]
    ends = [c.end for _, c in found]
    total: list[tuple[float, int]] = [(0.0, 0)]
    taken: list[tuple[int, bool]] = []
    for k, (score, c) in enumerate(found):
        before = bisect_right(ends, c.begin, 0, k)
        with_it = (total[before][0] + score, total[before][1] + c.end - c.begin)
        taken.append((before, with_it > total[-1]))
        total.append(max(with_it, total[-1]))
    out, k = [], len(found)
    while k:
        before, use = taken[k - 1]
        if use:
            out.append(found[k - 1][1])
        k = before if use else k - 1
    return out[::-1]


class Detector:
    """The fitted classifier with its labelers; small enough to travel with a task."""

    def __init__(self, gazetteer: Gazetteer | None = None, given: Iterable[str] = GIVEN_NAMES, family: Iterable[str] = ()):
        """Names of a gazetteer, or given outright."""
        self.gazetteer, self.given, self.family = gazetteer, frozenset(given), frozenset(family)
        self.labelers = Labelers(self._is_given, self._is_family)
        self.weights = np.zeros(_VOTES + SPACE)
        self.votes: dict[str, tuple[np.ndarray, float]] = {}
        self.known: dict[tuple, float] = {}

    def _is_given(self, name: str) -> bool:
        return name in self.given or self.gazetteer is not None and self.gazetteer.holds("g", name)

    def _is_family(self, name: str) -> bool:
        return name in self.family or self.gazetteer is not None and self.gazetteer.holds("f", name)

    def learn(self, texts: list[str]) -> None:
        self.labelers.common = common_words(texts, self.labelers)
        found = [(t, c) for t in texts for c in self.labelers.candidates(t)]
        if not found:
            return
        votes = np.array([c.votes for _, c in found], np.int64)
        kinds = np.array([KINDS.index(c.kind) for _, c in found])
        target, start = np.zeros(len(found)), np.zeros(_VOTES + SPACE)
        for k, kind in enumerate(KINDS):
            mine = kinds == k
            if mine.any():
                target[mine], weights, prior = reliabilities(votes[mine])
                self.votes[kind] = weights, prior
                mine = start[k * len(LABELERS) * 3 : (k + 1) * len(LABELERS) * 3].reshape(-1, 3)
                mine[:, [0, 2]] = weights
                mine[0] += np.log(prior / (1 - prior))  # of the first labeler every candidate has one vote
        self.weights = fit(np.array([features(t, c) for t, c in found]), target, start)
        self.known.clear()

    def score(self, text: str, c: Candidate) -> float:
        """The classifier's log odds, from a bounded memory of the weights of votes, words and shapes met before."""
        known = self.known
        total = known.get((c.kind, c.votes))
        if total is None:
            total = known[c.kind, c.votes] = sum(float(self.weights[i]) for i in _places(c))
        for mark, x in surroundings(text, c):
            w = known.get((c.kind, mark, x))
            if w is None:
                if len(known) > 300_000:
                    known.clear()
                w = known[c.kind, mark, x] = float(self.weights[_place(c.kind, mark, x)])
            total += w
        return total

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """``begin``, ``end``, ``kind`` of the personal data in a text, in order and disjoint."""
        return [(c.begin, c.end, c.kind) for c in best([(self.score(text, c), c) for c in self.labelers.candidates(text)])]


def free_texts(events: DataFrame, parts: DataFrame) -> DataFrame:
    """``tbl``, ``row_no``, ``text`` of both tables; null and empty texts left out."""
    e = events.select(F.lit("vevents").alias("tbl"), F.col("event_no").alias("row_no"), F.col("description").alias("text"))
    p = parts.select(F.lit("parts").alias("tbl"), F.col("part_no").alias("row_no"), "text")
    return e.unionByName(p).filter("text is not null and text <> '' and row_no is not null")


def train(events: DataFrame, parts: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Detector:
    """A detector for these tables. The sample is every row whose hash is below a bound that ``sample_rows`` sets."""
    detector = Detector(Gazetteer(names_known(events)))
    sample = []
    for table, key, column in ((events, "event_no", "description"), (parts, "part_no", "text")):
        n = table.count()
        bound = int(1_000_000 * min(1.0, sample_rows / 2 / max(1, n)))
        rows = table.filter((F.pmod(F.xxhash64(F.lit(1), key), F.lit(1_000_000)) <= bound) & F.col(column).isNotNull()).select(F.col(column))
        sample += [r[0] for r in rows.limit(sample_rows).collect()]
    detector.learn(sample)
    return detector


def _finder(detector: Detector) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tbl, no, text in zip(batch.column("tbl").to_pylist(), batch.column("row_no").to_pylist(), batch.column("text")):
                rows += [(tbl, no, kind, a, b) for a, b, kind in detector.spans(text.as_py())]
            if rows:
                types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["tbl", "row_no", "kind", "begin_at", "end_at"])

    return run


def found_spans(events: DataFrame, parts: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``tbl``, ``row_no``, ``kind``, ``begin_at``, ``end_at`` of every piece of personal data in ``description`` and ``text``.

    Places count code points from 0, ends exclusive. Null and empty texts have
    none; whole texts are read, however long. Rows of one number give their
    spans each.
    """
    detector = detector or train(events, parts)
    return free_texts(events, parts).mapInArrow(_finder(detector), "tbl string, row_no bigint, kind string, begin_at bigint, end_at bigint")


def masked(text: Column, detector: Detector) -> Column:
    """The text with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` and ``[NAME]`` in place of personal data; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if not t:
                return t
            out, at = [], 0
            for a, b, kind in detector.spans(t):
                out += [t[at:a], f"[{kind.upper()}]"]
                at = b
            return "".join(out) + t[at:]

        return s.map(one)

    return run(text)


def masked_texts(events: DataFrame, parts: DataFrame) -> DataFrame:
    """``tbl``, ``row_no``, ``text``: every row of both tables, its personal data replaced."""
    detector = train(events, parts)
    e = events.select(F.lit("vevents").alias("tbl"), F.col("event_no").alias("row_no"), F.col("description").alias("text"))
    p = parts.select(F.lit("parts").alias("tbl"), F.col("part_no").alias("row_no"), "text")
    return e.unionByName(p).select("tbl", "row_no", masked(F.col("text"), detector).alias("text"))


def span_faults(events: DataFrame, parts: DataFrame) -> DataFrame:
    """What spans and masked texts keep: one row per text that is not empty, all counts of faults 0.

    ``outside``, spans that don't lie within the text; ``overlapping``, spans
    that begin before the one before ends; ``altered``, whether the masked text
    differs from the text with each span replaced, built here by Catalyst.
    """
    detector = train(events, parts)
    texts = free_texts(events, parts)
    along = W.partitionBy("tbl", "row_no").orderBy("begin_at")
    found = found_spans(events, parts, detector).withColumn("last", F.coalesce(F.lag("end_at").over(along), F.lit(0)))
    piece = F.struct("begin_at", "last", "end_at", "kind")
    rows = found.groupBy("tbl", "row_no").agg(F.array_sort(F.collect_list(piece)).alias("spans"), F.max("end_at").alias("reach"), F.count_if((F.col("begin_at") < 0) | (F.col("end_at") <= F.col("begin_at"))).alias("bad"), F.count_if(F.col("begin_at") < F.col("last")).alias("overlapping"))
    rows = texts.join(rows, ["tbl", "row_no"], "left")
    cut = lambda a, n: F.substring(F.col("text"), a.cast("int"), n.cast("int"))
    head = F.array_join(F.transform("spans", lambda x: F.concat(cut(x["last"] + 1, x["begin_at"] - x["last"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), "")
    built = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.concat(head, cut(F.col("reach") + 1, F.length("text") - F.col("reach"))))
    outside = F.coalesce("bad", F.lit(0)) + F.when(F.col("reach") > F.length("text"), 1).otherwise(0)
    return rows.select("tbl", "row_no", F.length("text").cast("bigint").alias("n_chars"), outside.cast("bigint").alias("outside"), F.coalesce("overlapping", F.lit(0)).cast("bigint").alias("overlapping"), F.when(built == masked(F.col("text"), detector), 0).otherwise(1).cast("bigint").alias("altered"))
