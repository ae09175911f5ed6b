"""Language identification in two steps: the family, then the language within it.

Features are hashed grams of two and three bytes of the lower-cased text, as shares of all
grams. One linear support vector machine per family separates it from the others; within a family one
per pair of languages. All are trained on a bounded sample and applied to whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from wavecohort.llm.blocks import LOWER, SPACE, Block, batch, blocks

#: Bounds of the training sample: texts of one language, and of all as long as there are two of each language.
PER_LANGUAGE = 250
TOTAL = 1500
#: Hashed features of each gram length.
SLOTS = 1 << 13
UNKNOWN = "und"

#: Language codes of one family; fixed values. A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl af lb fy sv da no nb nn is fo yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "indic": "hi bn mr gu pa ur ne si",
    "turkic": "tr az kk ky uz tt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "semitic": "ar he mt am",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv tl",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def grams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature of every gram of a block, pairs first, and the text it is in. White space and digits count as blanks."""
    data = np.where(SPACE[block.data] | ((block.data >= 48) & (block.data <= 57)), 32, LOWER[block.data])
    data = data.astype(np.uint32)
    of = np.repeat(np.arange(len(block), dtype=np.int32), np.diff(block.offsets))
    two = (data[:-1] << 8) | data[1:]
    three = (two[:-1] << 8) | data[2:]
    found = [((x * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64) for x in (two, three)]
    inside = [of[:-1] == of[1:], of[:-2] == of[2:]]
    where = [of[:-1][inside[0]], of[:-2][inside[1]]]
    return np.concatenate((found[0][inside[0]], found[1][inside[1]] + SLOTS)), np.concatenate(where)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its language and place, the features it has and their shares."""
    for b in batches:
        for block in blocks(b.column(2)):
            found, of = grams(block)
            keys, n = np.unique(of.astype(np.int64) * 2 * SLOTS + found, return_counts=True)
            total = np.bincount(of, minlength=len(block))
            cut = np.searchsorted(keys, np.arange(len(block) + 1) * 2 * SLOTS).astype(np.int32)
            share = (n / total[keys // (2 * SLOTS)]).astype(np.float32)
            yield batch(
                lang=b.column(0).slice(block.first, len(block)),
                place=b.column(1).slice(block.first, len(block)),
                slot=pa.ListArray.from_arrays(cut, (keys % (2 * SLOTS)).astype(np.int32)),
                share=pa.ListArray.from_arrays(cut, share),
            )


def svm(near: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = 20) -> np.ndarray:
    """Weight of each text in a linear machine, by dual coordinate descent; y is -1 or 1.

    ``near`` holds the products of all pairs of texts. A constant feature stands for the
    intercept; both sides weigh the same, however many texts they have.
    """
    near = near + 1.0
    alpha, value = np.zeros(len(y)), np.zeros(len(y))
    draw = np.random.Generator(np.random.PCG64(seed))
    most = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y) * cost
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * value[i] - 1) / near[i, i], 0.0), most[i])
            if new != alpha[i]:
                value += (new - alpha[i]) * y[i] * near[i]
                moved = max(moved, abs(new - alpha[i]) * near[i, i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return alpha * y


@dataclass
class Model:
    """``weights`` has a column per machine: one for each family, then one for each pair of a family."""

    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # features x machines
    bias: np.ndarray
    scale: np.ndarray  # typical distance of a training text from each machine's plane

    def __post_init__(self) -> None:
        own: dict[str, list[str]] = {f: [] for f in self.families}
        for a, b in self.pairs:
            for lang in (a, b):
                if lang not in own[family(lang)]:
                    own[family(lang)].append(lang)
        self.members = own

    def margins(self, block: Block) -> np.ndarray:
        found, of = grams(block)
        n = np.bincount(of, minlength=len(block))
        out = np.empty((len(block), self.weights.shape[1]))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(of, self.weights[found, k], minlength=len(block))
        return (out / np.maximum(n, 1)[:, None] + self.bias) / self.scale

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        """Language of each text and how sure both steps are, 0 to 1."""
        margin = self.margins(block)
        sure = 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))
        names, score = [""] * len(block), np.ones(len(block))
        best = np.argmax(margin[:, : len(self.families)], axis=1)
        if len(self.families) > 1:
            score = sure[np.arange(len(block)), best]
        for number, name in enumerate(self.families):
            rows = np.flatnonzero(best == number)
            langs = self.members[name] or [name]
            votes, belief = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for k, (a, b) in enumerate(self.pairs, len(self.families)):
                if a in langs:
                    i, j = langs.index(a), langs.index(b)
                    p = sure[rows, k]
                    votes[:, i] += p >= 0.5
                    votes[:, j] += p < 0.5
                    belief[:, i] += p
                    belief[:, j] += 1 - p
            pick = np.argmax(votes + belief / (len(langs) + 1), axis=1) if len(rows) else []
            if len(langs) > 1:
                score[rows] *= belief[np.arange(len(rows)), pick] / (len(langs) - 1)
            for row, lang in zip(rows.tolist(), pick):
                names[row] = langs[lang]
        return names, score


def fit(langs: list[str], slots: list[np.ndarray], shares: list[np.ndarray]) -> Model:
    """Train all machines on features of some texts."""
    x = np.zeros((len(langs), 2 * SLOTS), np.float32)
    for row, (slot, share) in enumerate(zip(slots, shares)):
        x[row, slot] = share
    # Features of like size, texts of a length near one.
    factor = (1 / np.sqrt(np.maximum((x * x).mean(axis=0), 1e-9) * x.shape[1])).astype(np.float32)
    x *= factor
    near = (x @ x.T).astype(float)
    lang = np.array(langs)
    kin = np.array([family(a) for a in langs])
    families = sorted(set(kin))
    own = {f: sorted(set(lang[kin == f])) for f in families}
    pairs = [(a, b) for f in families for a in own[f] for b in own[f] if a < b]
    sides = [(kin == f, np.ones(len(lang), bool)) for f in families]
    sides += [(lang == a, (lang == a) | (lang == b)) for a, b in pairs]
    weights, bias, scale = [], [], []
    for side, rows in sides:
        y = np.where(side, 1.0, -1.0)[rows]
        part = np.zeros(len(lang))
        if 0 < (y > 0).sum() < len(y):
            part[rows] = svm(near[np.ix_(rows, rows)], y)
        weights.append((part @ x) * factor)
        bias.append(part.sum())
        scale.append(max(1e-9, float(np.abs(near[rows] @ part + part.sum()).mean())))
    model = Model(families, pairs, np.stack(weights, axis=1), np.array(bias), np.array(scale))
    names = {f: own[f][0] for f in families if len(own[f]) == 1}
    for f, only in names.items():
        model.members[f] = [only]
    return model


def train(docs: DataFrame, text: str = "text", lang: str = "lang", draw: str = "doc_id") -> Model | None:
    """Train on at most ``TOTAL`` texts (or two of each language, if that is more); None if there is nothing to learn from.

    Of each language those with the smallest hashes of ``draw`` and text are taken; copies that
    agree in both count once. Rows without language and texts without letters are left out. Every language is learned;
    one count for each and the sample's features come to the driver.
    """
    place = F.shiftrightunsigned(F.xxhash64(draw, text), 1)
    known = docs.where(F.col(lang).isNotNull() & lettered(text))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), place.alias("place"))
    counts = known.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return None
    cuts = _cuts(known, {r[0]: r[1] for r in counts}, max(2, min(PER_LANGUAGE, TOTAL // len(counts))))
    sample = _below(known, cuts).groupBy("lang", "place").agg(F.min("text").alias("text"))
    kind = "lang string, place long, slot array<int>, share array<float>"
    rows = sample.mapInArrow(_features, kind).toArrow()
    langs = rows["lang"].to_pylist()
    order = np.lexsort((rows["place"].to_numpy(), np.array(langs)))
    take = lambda n: [rows[n][int(i)].values.to_numpy() for i in order]
    return fit([langs[i] for i in order], take("slot"), take("share"))


def _below(known: DataFrame, cuts: dict[str, int]) -> DataFrame:
    """Rows up to the cut of their language."""
    bounds = pa.table({"lang": pa.array(list(cuts), pa.string()), "cut": pa.array(list(cuts.values()), pa.int64())})
    return known.join(known.sparkSession.createDataFrame(bounds), "lang").where("place <= cut").drop("cut")


def _cuts(known: DataFrame, counts: dict[str, int], most: int) -> dict[str, int]:
    """Per language the place of its ``most``-th different row, or the last place if it has fewer.

    Only places up to a bound are ranked: one that some times ``most`` rows are below, as far as
    rows differ; where too few do, a larger one.
    """
    last, cuts, share = (1 << 63) - 1, {}, 4 * most + 64
    order = Window.partitionBy("lang").orderBy("place")
    while left := {k: n for k, n in counts.items() if k not in cuts}:
        near = _below(known, {k: last * min(share, n) // n for k, n in left.items()}).select("lang", "place")
        ranked = near.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
        found = ranked.groupBy("lang").agg(F.max("place"), F.count("*")).collect()
        cuts |= {k: cut for k, cut, n in found if n == most}
        cuts |= {k: last for k, n in left.items() if k not in cuts and share >= n}
        share *= 64
    return cuts


def identify(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1.

    Texts that are null or have no letter, and all texts if there is no model, are ``und`` with score 0. Only the text is
    looked at. Whole rows pass through, so other columns keep their names and values; columns
    named like the new ones are replaced.
    """
    docs = docs.drop(lang, score)
    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(where)):
                own = b.slice(block.first, len(block))
                names, sure = model.predict(block) if model else ([UNKNOWN] * len(block), np.zeros(len(block)))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array(names, pa.string()), pa.array(sure)], names=[*own.schema.names, lang, score]
                )

    out = docs.mapInArrow(run, schema)
    return out.withColumns(
        {
            lang: F.when(lettered(text), F.col(lang)).otherwise(UNKNOWN),
            score: F.when(lettered(text), F.col(score)).otherwise(0.0),
        }
    )


def lettered(text: str = "text") -> Column:
    """Whether a text is not null and has a letter."""
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id", every: int = 5):
    """Rows that training never sees: one in ``every`` by id, and rows without id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(every)) == 0, F.lit(True))
