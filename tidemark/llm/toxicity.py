"""Toxicity: a weighted finite-state pattern grammar over classes of words, scoring the clauses that it matches.

Small transducers for target, threat, insult, negation and reported speech read the word classes of a clause side by side; their
composition is one deterministic machine over (state of each), whose arcs multiply or add weight. Insult arcs carry weights that are
learned from labelled documents (log odds of words and of word beginnings, so that inflected forms match); listed words keep their class,
and a listed insult weighs LISTED at least. Only clauses with an insult or a threat are walked. A logistic curve turns the scores of a
text's clauses, and nothing else, into a score between 0 and 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.quality import labelled_sample
from tidemark.llm.shared import _GOLDEN, BYTE, _is_word, materialise, mix, powers, slices, text_bytes

#: Labelled documents that are learned from at most, and the least support and log odds of a learned form.
SAMPLE, SUPPORT, LEAST = 20_000, 6, 2.0
BEGINNINGS = (4, 5, 6, 7, 8)
LISTED, STRONG = 1.0, 4.0

WORD, INSULT, THREAT, TARGET, NEGATION, REPORT, STRONGER = range(7)
#: Public everyday words of the four languages of the corpus. A word that ends in n't, and the French n', are negations too.
LEXICON = {
    INSULT: "idiot moron stupid dumb loser pathetic scum trash garbage worthless disgusting clown freak imbecile dummkopf trottel abschaum wertlos imbécile crétin ordure estúpido imbécil basura inútil",
    THREAT: "kill hurt destroy beat shoot burn stab töten schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours he she they them him her his their du dich dir ihr euch sie er tu te toi vous il elle ils tú te usted él ella ellos",
    NEGATION: "not no never nobody neither without cannot nicht kein keine nie niemals ne pas jamais aucun no nunca jamás sin ningún",
    REPORT: "said says say wrote writes claimed claims called reported quoted quotes sagte sagt schrieb behauptet dit disait écrit selon dijo dice escribió según",
    STRONGER: "very so such total complete utter absolute really sehr so total völlig très si totalement muy tan totalmente",
}
#: Endings with which a listed insult is listed too.
ENDINGS = ("s", "es", "e", "en")


class Transducer:
    """arcs: (state, class) -> (next state, factor of the insult or threat there, weight added). Any other word takes the rest: states
    count down to 0."""

    def __init__(self, arcs: dict) -> None:
        self.arcs = arcs

    def step(self, state: int, kind: int) -> tuple[int, float, float]:
        return self.arcs.get((state, kind), (max(state - 1, 0), 1.0, 0.0))


def _window(kind: int, factor: float, span: int) -> Transducer:
    """A word of `kind` changes hits within the next `span` words by `factor`."""
    arcs = {(s, kind): (span, 1.0, 0.0) for s in range(span + 1)}
    for s in range(1, span + 1):
        for hit in (INSULT, THREAT):
            arcs[s, hit] = (s - 1, factor, 0.0)
    return Transducer(arcs)


def _after(kind: int, added: float, span: int) -> Transducer:
    """A word of `kind` within `span` words after an insult or threat adds weight."""
    arcs = {(s, hit): (span, 1.0, 0.0) for s in range(span + 1) for hit in (INSULT, THREAT)}
    for s in range(1, span + 1):
        arcs[s, kind] = (0, 1.0, added)
    return Transducer(arcs)


def compose(parts: list[Transducer]):
    """The transducers run side by side: a table over tuples of states, filled as states are met."""
    table: dict = {}

    def step(state: tuple, kind: int):
        if (found := table.get((state, kind))) is None:
            moves = [p.step(s, kind) for p, s in zip(parts, state)]
            found = table[state, kind] = (tuple(m[0] for m in moves), float(np.prod([m[1] for m in moves])), sum(m[2] for m in moves))
        return found

    return step, (0,) * len(parts)


GRAMMAR = [_window(NEGATION, 0.5, 3), _window(REPORT, 0.6, 6), _window(TARGET, 1.3, 5), _window(STRONGER, 1.2, 2), _after(TARGET, 0.5, 4)]
#: A threat weighs only in a clause with a target.
THREAT_WEIGHT = 1.0


def clause_score(place: list[int], kinds: list[int], weights: list[float], step, start: tuple) -> float:
    """Weight of one clause from its words that have a class, at their places; threats count only if the clause has a target. What a
    target adds after an insult is changed by negation and report as the insult was."""
    state, total, last, at, aimed = start, 0.0, 1.0, place[0] - 1, TARGET in kinds
    for p, kind, weight in zip(place, kinds, weights):
        if gap := p - at - 1:
            state = tuple(max(s - gap, 0) for s in state)
        at = p
        state, factor, added = step(state, kind)
        if kind == INSULT or kind == THREAT and aimed:
            total += weight * factor
            last = factor
        total += added * last
    return total


def word_forms(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of lower-cased texts: (row, clause, contracted) of each word and the hashes of its forms: the whole word, then its beginnings of 4
    to 8 bytes (0 where the word is no longer than that). Clauses end at . ! ? ; and line ends. contracted: the word is the t of n't or
    the n of n', apostrophes being separators."""
    data, offsets = text_bytes(column)
    inside = _is_word[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), [np.zeros(0, np.uint64)] * (1 + len(BEGINNINGS))
    ends = np.cumsum(np.isin(data, np.frombuffer(b".!?;\n", np.uint8)))
    row = np.searchsorted(offsets, starts, side="right") - 1
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = np.where(inside, BYTE[data], np.uint64(0))[starts[0] :] * powers(place)
    size = np.add.reduceat(inside[starts[0] :].astype(np.int64), starts - starts[0])
    forms = [mix(np.add.reduceat(value, starts - starts[0]))]
    part = np.zeros(len(starts), np.uint64)
    padded = np.append(value, np.zeros(8, np.uint64))
    for j in range(BEGINNINGS[-1]):
        part = part + np.where(size > j, padded[starts - starts[0] + j], np.uint64(0))
        if j + 1 in BEGINNINGS:
            forms.append(np.where(size > j + 1, mix(part + np.array(j + 1, np.uint64)[None] * _GOLDEN), np.uint64(0)))
    around = np.concatenate([np.zeros(2, np.uint8), data, np.zeros(2, np.uint8)])  # data[i] is around[i + 2]
    # looks back and ahead within the text alone: its neighbours in the batch do not count
    t = (data[starts] == ord("t")) & (around[starts + 1] == ord("'")) & (around[starts] == ord("n")) & (starts - 2 >= offsets[row])
    n = (data[starts] == ord("n")) & (around[starts + 3] == ord("'")) & (starts + 1 < offsets[row + 1])
    return row, ends[starts], (size == 1) & (t | n), forms


def _hash_of(word: str) -> int:
    import pyarrow as pa

    return int(word_forms(pa.array([word]))[3][0][0])


class Lexicon:
    """Sorted form hashes with class and weight, and a bit table that turns most words away."""

    def __init__(self, learned: dict[int, float]) -> None:
        table: dict[int, tuple[int, float]] = {}
        for kind, listed in LEXICON.items():
            for word in listed.split():
                for form in (word, *(word + e for e in ENDINGS)) if kind == INSULT else (word,):
                    h = _hash_of(form)
                    table.setdefault(h, (kind, max(LISTED, learned.get(h, 0.0)) if kind == INSULT else THREAT_WEIGHT))
        for h, weight in learned.items():  # a listed class stays
            table.setdefault(h, (INSULT, weight))
        self.hashes = np.array(sorted(table), np.uint64)
        self.kinds = np.array([table[int(h)][0] for h in self.hashes])
        self.weights = np.array([table[int(h)][1] for h in self.hashes])
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def classes(self, forms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Class and weight of each word: its own entry or, for insults, the heaviest of its forms."""
        n = len(forms[0])
        kind, weight = np.zeros(n, np.int64), np.zeros(n)
        for form in forms:
            maybe = np.flatnonzero(self.bits[(form & np.uint64(0xFFFF)).astype(np.int64)] & (form != 0))
            at = np.minimum(np.searchsorted(self.hashes, form[maybe]), len(self.hashes) - 1)
            hit = self.hashes[at] == form[maybe]
            maybe, at = maybe[hit], at[hit]
            better = (kind[maybe] == WORD) | (kind[maybe] == INSULT) & (self.kinds[at] == INSULT) & (self.weights[at] > weight[maybe])
            kind[maybe[better]], weight[maybe[better]] = self.kinds[at[better]], self.weights[at[better]]
        return kind, weight


N_FEATURES = 5


def clause_features(column, lexicon: Lexicon) -> np.ndarray:
    """(n, N_FEATURES) of lower-cased texts, all from clause scores: their sum, the greatest, how many are over 0 and over STRONG, and the
    number of clauses with words."""
    n = len(column)
    row, clause, contracted, forms = word_forms(column)
    out = np.zeros((n, N_FEATURES))
    kind, weight = lexicon.classes(forms)
    kind[contracted] = NEGATION
    where = row * (int(clause.max()) + 1) + clause if len(clause) else clause
    new = np.ones(len(where), bool)
    new[1:] = where[1:] != where[:-1]
    out[:, 4] = np.bincount(row[new], minlength=n)
    number = np.cumsum(new)
    hits = (kind == INSULT) | (kind == THREAT)
    if hits.any():
        words = np.flatnonzero((kind != WORD) & np.isin(number, np.unique(number[hits])))
        cuts = np.flatnonzero(np.diff(number[words])) + 1
        step, start = compose(GRAMMAR)
        for part in np.split(words, cuts):
            i = row[part[0]]
            score = clause_score(part.tolist(), kind[part].tolist(), weight[part].tolist(), step, start)
            out[i, 0] += score
            out[i, 1] = max(out[i, 1], score)
            out[i, 2] += score > 0
            out[i, 3] += score >= STRONG
    return out


def _shape(x: np.ndarray) -> np.ndarray:
    """Features as the curve takes them: the logarithm of the sum, the greatest, numbers of clauses held at 8, and the sum and the
    matched clauses against all clauses."""
    clauses = np.maximum(x[:, 4], 1)
    return np.column_stack([np.log1p(x[:, 0]), x[:, 1] / 5, np.minimum(x[:, 2], 8), np.minimum(x[:, 3], 8), np.log1p(x[:, 0] / clauses), x[:, 2] / clauses])


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, curve: np.ndarray) -> None:
        self.lexicon, self.curve = lexicon, curve

    def score(self, column) -> np.ndarray:
        x = clause_features(column, self.lexicon)
        z = self.curve[0] + _shape(x) @ self.curve[1:]
        return np.where(x[:, 2] > 0, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.01)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; intercept first."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        beta = beta - np.linalg.solve(a.T @ (a * w[:, None]) + penalty, a.T @ (p - y) + penalty @ beta)
    return beta


def _lower(column):
    import pyarrow.compute as pc

    return pc.replace_substring(pc.utf8_lower(pc.fill_null(column, "")), "’", "'")


def train(docs: DataFrame, labels: DataFrame, seen, rows: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns insult weights on three quarters of the sample and the curve on the rest. No labels: listed words only."""
    sample = materialise(labelled_sample(docs, labels, label, seen, rows, key, text), "labelled")
    own = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(4)) > 0

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                row, _, _, forms = word_forms(_lower(batch["text"]))
                toxic = batch["label"].to_numpy()
                form, at = np.concatenate(forms), np.tile(row, len(forms))
                form, at = form[form != 0], at[form != 0]
                order = np.lexsort((at, form))
                form, at = form[order], at[order]
                new = np.ones(len(form), bool)
                new[1:] = (form[1:] != form[:-1]) | (at[1:] != at[:-1])
                form, at = form[new], at[new]
                forms_here, place = np.unique(form, return_inverse=True)
                bad = np.bincount(place, toxic[at], len(forms_here)).astype(np.int64) if len(form) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(forms_here.view(np.int64)), pa.array(bad), pa.array(np.bincount(place, minlength=len(forms_here)).astype(np.int64) - bad)], names=["form", "bad", "fine"])

    total = sample.where(own).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("*").alias("n")).first()
    bad_n, fine_n = total["bad"], total["n"] - total["bad"]
    odds = F.log((F.col("bad") + 0.5) / (bad_n + 1.0)) - F.log((F.col("fine") + 0.5) / (fine_n + 1.0))
    forms = sample.where(own).select("text", "label").mapInArrow(count, "form long, bad long, fine long").groupBy("form").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    top = forms.where(F.col("bad") >= SUPPORT).withColumn("w", odds).where(F.col("w") >= LEAST).collect()  # bounded by the sample's words
    lexicon = Lexicon({r["form"] & (1 << 64) - 1: float(r["w"]) for r in top})

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, ["text"]):
                x = clause_features(_lower(batch["text"]), lexicon)
                yield pa.RecordBatch.from_arrays([batch["label"], pa.array([r.tobytes() for r in x])], names=["label", "x"])

    rest = sample.where(~own).select("text", "label").mapInArrow(cut, "label int, x binary").collect()
    y = np.array([r["label"] for r in rest], np.float64)
    x = np.array([np.frombuffer(r["x"]) for r in rest]).reshape(len(rest), N_FEATURES)
    if len(y) < 50 or y.min() == y.max():
        return ToxicityModel(lexicon, np.array([-3.0, 2, 0, 0, 0, 0, 0]))
    met = x[:, 2] > 0  # texts without a match have a constant score
    if met.sum() < 20 or y[met].min() == y[met].max():
        return ToxicityModel(lexicon, np.array([-3.0, 2, 0, 0, 0, 0, 0]))
    return ToxicityModel(lexicon, logistic(_shape(x[met]), y[met]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (double) and predicted (int) added in their place. Null and wordless texts score as texts without a match."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, [at]):
                score = model.score(_lower(batch[at]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema))
    return docs.toDF(*names).mapInArrow(run, schema + ", score double, predicted int")


def toxicity_report(docs: DataFrame, model: ToxicityModel, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) of every row. Null, empty and wordless texts score as texts without a match; repeated rows are
    answered one by one; an empty table gives no rows; other columns are ignored, whatever their names."""
    rows = docs.select(F.col(key).alias("k"), F.coalesce(held_out, F.lit(False)).alias("h"), F.col(text).alias("t"))
    return score_toxicity(rows, model, "t").select(F.col("__c0").alias(key), F.col("__c1").alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The documents that are not rejected, with the input's columns, whatever their names. Null and empty texts and repeated rows stay;
    an empty table gives no rows."""
    scored = score_toxicity(docs, model, text).where("predicted = 0").drop("score", "predicted")
    return scored.toDF(*docs.columns)
