"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Labelled rows of the training folds give a lexicon of words and word beginnings, weighted by a lower bound of their
log odds between the classes.  Features of a row come from a lexicon of the other folds; they fit the trees, and
trees fitted without a fold calibrate on it.  Features of a text: densities of lexicon words and of what becomes one once letters written as
digits or signs are put back, distance to the nearest second-person word, share of capitals, punctuation and its
repetition.  Only the text is an input.

The fit uses at most ``sample`` labelled rows, one of an id (its smallest text), chosen by a hash of the id; the lexicon has at most ``lexicon`` terms.
Everything else reads every document, once, and scores it where it lies.

Defined results: null text counts as empty; empty texts get a score like any other; a null id is in no training
fold; labels that are null are not used, of several labels of one id the highest is; without labels of both classes
every score is the share of the one there is (0 without labels); an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.boosting import Boosted, Isotonic, fit_boosted, fit_isotonic
from hushframe.llm.catalog import query, table
from hushframe.session import written

SAMPLE = 20_000
LEXICON = 2_000
BEGINNINGS = (4, 5, 6, 7)  # bytes of a word that may be a term
STRONG = 3.0  # least weight of a strong term
KEPT_WORDS = 200_000  # words whose weight a task keeps at hand
TERMS = 300_000  # terms that a task counts before it passes them on
FOLDS = 4
HELD_OUT = 2
CALIBRATION = 3
NEAR = 5  # words between a second-person word and a lexicon word that still count as close

YOU = frozenset("you your yours yourself yourselves u ur ya youre thou thee du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos ti tus tuyo vos usted ustedes vosotros os".encode().split())
_LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SIGNS = bytes(c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123))
PLAIN = bytes.maketrans(_LOWER[0] + _SIGNS, _LOWER[1] + b" " * len(_SIGNS))
#: Letters written as digits or signs; signs put between letters are deleted.
LEET = bytes.maketrans(_LOWER[0] + b"013457@$!|+", _LOWER[1] + b"oieastasiit")
BETWEEN = b"*._-'\"`~^,;:?#%&()[]{}<>/\\="
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c < 91)
NOT_LETTER = bytes(c for c in range(128) if not (65 <= c < 91 or 97 <= c < 123))
NOT_SIGN = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum() or chr(c).isspace())
NAMES = ["words", "length", "hits", "hit_density", "weight_density", "most", "kinds", "strong", "strong_density", "hidden", "hidden_density", "close", "close_density",
         "nearest", "you_density", "capitals", "shouted", "signs", "exclaims", "asks", "repeats", "stretched"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


class Lexicon(dict):
    """Weight of the strongest term of a word, 0 without one; looked up once per word and then kept.

    Terms are whole words, which end in a space, and word beginnings, which do not.
    """

    def __init__(self, weights: dict[bytes, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: bytes) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        get = self.weights.get
        weight = self[word] = max(get(word + b" ", 0.0), *[get(word[:k], 0.0) for k in BEGINNINGS])
        return weight

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def found(self, words: list[bytes]) -> list[tuple[int, float]]:
        """(place, weight) of every word that has a term."""
        return [(i, weight) for i, weight in enumerate(map(self.__getitem__, words)) if weight]


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(PLAIN).split()
    n, size = max(1, len(words)), max(1, len(data))
    at = lexicon.found(words)
    places, found = [i for i, _ in at], [v for _, v in at]
    strongly = [i for i, v in at if v >= STRONG]
    hidden = max(0, sum(v >= STRONG for _, v in lexicon.found(data.translate(LEET, BETWEEN).split())) - len(strongly))
    you = np.array([i for i, w in enumerate(words) if w in YOU])
    near = [int(np.abs(you - i).min()) for i in strongly] if len(you) else []
    close = sum(d <= NEAR for d in near)
    letters = max(1, len(data.translate(None, NOT_LETTER)))
    shouted = sum(w.isupper() and len(w) > 2 for w in data.split()) if data[:1] else 0
    repeats = data.count(b"!!") + data.count(b"??") + data.count(b"!?")
    stretched = sum(data.count(bytes([c]) * 3) for c in b"aeiou")
    return [np.log1p(len(words)), np.log1p(size), float(len(places)), len(places) / n, sum(found) / n, max(found, default=0.0), float(len({words[i] for i in strongly})),
            float(len(strongly)), len(strongly) / n, float(hidden), hidden / n, float(close), close / n, float(min(near, default=99)), len(you) / n,
            len(data.translate(None, NOT_UPPER)) / letters, shouted / n, len(data.translate(None, NOT_SIGN)) / size, data.count(b"!") / n, data.count(b"?") / n, repeats / n, stretched / n]


@dataclass
class Toxicity:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(NAMES))
        return self.calibration(self.trees.raw(x))


def numbered(df: DataFrame) -> DataFrame:
    """Columns named by place, so that names that hold a dot or differ in case only cannot clash."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def picked(df: DataFrame, **names: str) -> DataFrame:
    """The columns given by name, under new names."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(old)}").alias(new) for new, old in names.items()])


def fold(id: str):
    return F.crc32(F.col(id).cast("string")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, text: str, id: str, label: str, sample: int) -> DataFrame:
    """(id, label, fold, text) of at most ``sample`` labelled documents of the training folds, stored."""
    rows = picked(labels, id=id, label=label).withColumn("label", F.col("label").cast("int")).dropna().groupBy("id").agg(F.max("label").alias("label"))
    rows = rows.withColumn("fold", fold("id")).filter(F.col("fold") != HELD_OUT).orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = picked(docs, id=id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    found = texts.join(F.broadcast(rows), "id")  # at most ``sample`` rows are broadcast
    once = found.groupBy("id", "label", "fold").agg(F.min("text").alias("text"))  # rows of an id, however many, count once
    return written(once.select("id", "text", "label", "fold"), "toxicity-sample")


def terms_of(text: str | None) -> set[bytes]:
    words = set(words_of(text))
    return {w + b" " for w in words}.union(*[{w[:k] for w in words if len(w) >= k} for k in BEGINNINGS])


def counted_terms(texts: DataFrame, folds: list[int]) -> DataFrame:
    """(label, fold, text) to term, a<fold> toxic and n<fold> all documents that have it; terms with 3 toxic ones."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, int], list[int]] = {}
        for b in batches:
            for label, at, t in zip(*[c.to_pylist() for c in b.columns]):
                for term in terms_of(t):
                    c = counts.setdefault((term, at), [0, 0])
                    c[0] += label
                    c[1] += 1
                if len(counts) > TERMS:
                    yield batch_of(counts)
                    counts = {}
        yield batch_of(counts)

    def batch_of(counts: dict[tuple[bytes, int], list[int]]) -> pa.RecordBatch:
        columns = [t for t, _ in counts], [f for _, f in counts], [c[0] for c in counts.values()], [c[1] for c in counts.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["term", "fold", "a", "n"])

    of = lambda name, f: F.sum(F.when(F.col("fold") == f, F.col(name)).otherwise(0)).alias(f"{name}{f}")
    terms = texts.mapInArrow(run, "term binary, fold bigint, a bigint, n bigint").groupBy("term").agg(F.sum("a").alias("a"), *[of(x, f) for f in folds for x in "an"])
    return written(terms.filter("a >= 3").drop("a"), "toxicity-terms")


def learned_lexicon(terms: DataFrame, sizes: dict[int, tuple[int, int]], folds: list[int], size: int) -> Lexicon:
    """The terms with the highest z scores of their log odds, toxic against not, in these folds."""
    toxic, texts = (float(sum(sizes.get(f, (0, 0))[i] for f in folds)) for i in (0, 1))
    clean = texts - toxic
    if not toxic or not clean:
        return Lexicon({})
    a = sum((F.col(f"a{f}") for f in folds), F.lit(0.5))
    b = sum((F.col(f"n{f}") for f in folds), F.lit(1.0)) - a
    odds = F.log(a / (toxic + 1.0 - a)) - F.log(b / (clean + 1.0 - b))
    error = F.sqrt(1 / a + 1 / (toxic + 1.0 - a) + 1 / b + 1 / (clean + 1.0 - b))
    top = terms.filter(a > 2).withColumn("odds", odds).withColumn("error", error).withColumn("z", odds / error)
    top = top.filter("z > 2").orderBy(F.desc("z"), "term").limit(size).select("term", (F.col("odds") - 1.64 * F.col("error")).alias("weight"))
    return Lexicon({bytes(r["term"]): float(r["weight"]) for r in top.collect()})  # at most ``size`` terms


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON) -> Toxicity:
    """Every sampled row gets its features from a lexicon that has not seen its fold, as unseen texts will."""
    rows = labelled_sample(docs, labels, text, id, label, sample)
    folds = [f for f in range(FOLDS) if f != HELD_OUT]
    texts = written(rows.select((F.col("label") > 0).cast("bigint").alias("label"), F.col("fold").cast("bigint").alias("fold"), "text").distinct(), "toxicity-texts")
    sizes = {r["fold"]: (r["toxic"], r["n"]) for r in texts.groupBy("fold").agg(F.sum("label").alias("toxic"), F.count("*").alias("n")).collect()}
    terms = counted_terms(texts, folds)
    apart = {f: learned_lexicon(terms, sizes, [g for g in folds if g != f], lexicon) for f in folds}
    kinds = ", ".join(f"x{i} double" for i in range(len(NAMES)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, apart[f]) for f, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())], float).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(c) for c in x.T]], ["id", "label", "fold", *[f"x{i}" for i in range(len(NAMES))]])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", F.col("label").cast("bigint"), F.col("fold").cast("bigint"), "text").mapInArrow(run, f"id {kind}, label bigint, fold bigint, {kinds}")
    got = got.orderBy("id", "x0", "x1").toPandas()  # at most ``sample`` rows of numbers for distinct ids
    x, y, seen = got.iloc[:, 3:].to_numpy(float), (got["label"] > 0).to_numpy(float), (got["fold"] != CALIBRATION).to_numpy()
    if not y.size or y.min() == y.max():
        return Toxicity(Lexicon({}), Boosted(0.0, 0.0), Isotonic(np.zeros(1), np.full(1, float(y.mean()) if y.size else 0.0), 0.0))
    unseen = ~seen if y[~seen].size and y[~seen].min() < y[~seen].max() else np.ones(len(y), bool)
    calibration = fit_isotonic(fit_boosted(x[seen], y[seen]).raw(x[unseen]), y[unseen])
    return Toxicity(learned_lexicon(terms, sizes, folds, lexicon), fit_boosted(x, y), calibration)


def scored(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """Columns by place (c0, c1, …) and ``score``."""
    at, held = docs.columns.index(text), numbered(docs)
    names = held.columns
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields], "score double"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(at).to_pylist()), pa.float64())], [*names, "score"])

    return held.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text", id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The documents that score below ``threshold``, columns unchanged."""
    kept = scored(docs, fit(docs, labels, text, id, label), text).filter(F.col("score") < threshold)
    return kept.drop("score").toDF(*docs.columns)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs.select("doc_id", "text"), model).select(F.col("c0").alias("doc_id"), "score")
    return rows.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
