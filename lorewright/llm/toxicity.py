"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text, all from its own bytes: density and number of lexicon words, of lexicon words met only after undoing
obfuscation (digits and signs for letters, letters spaced by signs, a letter drawn out), of lexicon words within WINDOW words
of a second person, of second persons; shares of capitals and of words in capitals; rates of exclamation and question marks,
of other marks, and of words with marks or digits inside. Length is left out but for its logarithm, as a guard for densities.

There are two lexicons. One is a fixed list. The other is learned: words and beginnings of words of PREFIXES bytes that stand
in LEAST toxic texts of the sample or more, by a log-odds of which the lower bound at 1.5 standard errors is MINIMUM or more;
that bound is the term's weight, and a word weighs as its heaviest term. Texts that train the trees are measured by a lexicon
learned without their own fold, so the trees meet it as they will meet it on new texts; texts of one beginning share a fold.

Fitting takes a sample of SAMPLE labelled texts at most, those of the smallest hashes of doc_id among rows whose
crc32(doc_id) mod 4 is not 2; equal texts of one label count once; two thirds fit the trees, one third the calibration.
Scoring is one pass over the documents.

Defined results: null and empty texts have the features of an empty text and a score; labels that are null or of unknown
documents are not used, repeated labels count as their largest; with no labels of both kinds a fixed rule on lexicon density
takes the model's place; a null id is not held out; rows keep their ids, null or repeated; an empty table gives no rows;
columns other than the two named are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Isotonic, Trees
from .textkit import _LOWER, _TABLE, U64, Stored, flat, light, mix, pieces, powers, prefix, signed, words

SAMPLE = 12_000
WINDOW = 6
FOLDS, LEAST, MINIMUM, PREFIXES, TERMS, PARTS = 4, 3, 1.1, (4, 5, 6, 7, 8), 20_000, 16
THRESHOLD = 0.3
LEXICON = """idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass scum scumbag loser losers pathetic worthless
disgusting trash garbage clown clowns fool fools imbecile cretin jerk jerks bastard bastards bitch bitches asshole assholes
arsehole shit shitty bullshit crap fuck fucking fucked fucker motherfucker dick dickhead prick cunt whore slut twat wanker
retard retarded freak creep pig swine vermin filth filthy ugly hate hateful despicable disgrace useless coward liar parasite
degenerate lowlife douche douchebag sucker braindead brainless halfwit nitwit dimwit psycho lunatic
idiote idiotin dummkopf arschloch scheisse scheiße hurensohn schlampe fotze wichser depp trottel blödmann abschaum versager
ekelhaft erbärmlich wertlos drecksau miststück
imbécile connard connards connasse salaud salope merde putain pute enculé crétin abruti débile ordure minable dégoûtant pathétique
idiota idiotas imbécil estúpido estúpida pendejo pendeja cabrón puta mierda gilipollas basura asqueroso patético inútil escoria
perdedor payaso hijoputa maricón""".split()
SECOND = "you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre tú usted ustedes vosotros tuyo".split()
_LEET = str.maketrans("013457@$!|€", "oieastasiie")
_ODD = re.compile(rb"[A-Za-z0-9\x80-\xff]*[0-9@$!|*._\-+#][A-Za-z0-9@$!|*._\-+#\x80-\xff]*[A-Za-z\x80-\xff0-9]")
_MARKS = np.zeros(256, bool)
_MARKS[[*range(33, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127)]] = True


def _hashes(terms: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(sorted(set(terms))))
    return np.unique(words(data, offsets)[0])


_LEXICON, _SECOND, _PLAIN = _hashes(LEXICON), _hashes(SECOND), set(LEXICON)
_DRAWN = _hashes([re.sub(r"(.)\1+", r"\1", w) for w in LEXICON])
NAMES = ["learned_density", "learned_count", "learned_weight", "learned_top", "learned_near_second_person"]
NAMES += ["lexicon_density", "lexicon_count", "disguised_density", "disguised_count", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "marks", "odd_words", "log_length"]


def _within(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are among the known, which are sorted; a table of their first bits settles most."""
    maybe = np.zeros(1 << 16, bool)
    maybe[known >> U64(48)] = True
    out = maybe[hashes >> U64(48)]
    at = np.flatnonzero(out)
    out[at] = known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]
    return out


def _revealed(word: bytes) -> bool:
    """A word with digits, signs or drawn-out letters that hides a lexicon word which it doesn't spell outright."""
    text = word.decode("utf-8", "replace").lower()
    for form in (text.translate(_LEET), text):
        form = re.sub(r"[^\w]|_|\d", "", form)
        if form in _PLAIN or re.sub(r"(.)\1+", r"\1", form) in _PLAIN:
            return True
    starred = re.sub(r"[*#_@$]", ".", text)
    if 0 < starred.count(".") < len(starred) - 1 and starred[0] != "." and starred[-1] != ".":
        return any(len(w) == len(starred) and w[0] == starred[0] and re.fullmatch(re.sub(r"[^\w.]", "", starred), w) for w in LEXICON)
    return False


def _drawn_out(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many words of each text are a lexicon word only once a letter that stands three times or more in a row stands once."""
    n, low = len(offsets) - 1, _LOWER[data]
    out = np.zeros(n)
    again = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (low[2:] >= 97) if len(low) > 2 else np.zeros(0, bool)
    rows = np.unique(np.searchsorted(offsets, np.flatnonzero(again) + 2, "right") - 1)
    for row in rows:  # few texts have any
        own = low[offsets[row] : offsets[row + 1]]
        ends = np.array([0, len(own)])
        keep = np.ones(len(own), bool)
        keep[1:] = own[1:] != own[:-1]
        plain, _, starts, stops = words(own, ends)
        squeezed, _, from_, to = words(own[keep], np.array([0, int(keep.sum())]))
        hit = _within(squeezed, _DRAWN) & ~_within(plain, _LEXICON) & (stops - starts > to - from_ + 1)
        out[row] = hit.sum()
    return out


def _terms(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their beginnings, each with its word's number."""
    sums, inverse = prefix(_TABLE[_LOWER[data]]), powers(len(data) + 1)[1]
    out, owner = [hashes], [np.arange(len(hashes))]
    for k in PREFIXES:
        long = np.flatnonzero(ends - starts > k)
        at = starts[long]
        out.append(mix((sums[at + k] - sums[at]) * inverse[at] + U64(k)))
        owner.append(long)
    return np.concatenate(out), np.concatenate(owner)


Lexicon = tuple[np.ndarray, np.ndarray]
NOTHING: Lexicon = (np.zeros(0, np.uint64), np.zeros(0))


def features(column: pa.Array, lexicon: Lexicon = NOTHING) -> np.ndarray:
    """One row of NAMES for each text; lexicon: sorted hashes of learned terms and their weights."""
    data, offsets = flat(column)
    n, sizes = len(column), np.diff(offsets)
    hashes, rows, starts, ends = words(data, offsets)
    total = lambda r, w=None: np.bincount(r, w, n) if len(r) else np.zeros(n)
    byte_rows = np.repeat(np.arange(n), sizes)
    at = lambda mask: total(byte_rows[mask])
    upper = (data >= 65) & (data <= 90)
    letters = np.maximum(at(((_LOWER[data] >= 97) & (_LOWER[data] <= 122)) | (data >= 128)), 1)
    n_words, chars = np.maximum(total(rows), 1), np.maximum(sizes, 1)
    bad, you = _within(hashes, _LEXICON), _within(hashes, _SECOND)
    weight = np.zeros(len(hashes))
    if len(lexicon[0]) and len(hashes):
        terms, owner = _terms(data, hashes, starts, ends)
        maybe = np.zeros(1 << 20, bool)  # most terms end here
        maybe[lexicon[0] >> U64(44)] = True
        some = np.flatnonzero(maybe[terms >> U64(44)])
        terms, owner = terms[some], owner[some]
        place = np.minimum(np.searchsorted(lexicon[0], terms), len(lexicon[0]) - 1)
        hit = lexicon[0][place] == terms
        np.maximum.at(weight, owner[hit], lexicon[1][place[hit]])
    learned = weight > 0
    top = np.zeros(n)
    np.maximum.at(top, rows[learned], weight[learned])
    near = np.zeros(len(hashes), bool)
    for k in range(1, WINDOW + 1):
        same = rows[k:] == rows[:-k]
        near[k:] |= same & you[:-k]
        near[:-k] |= same & you[k:]
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts >= 3)
    # words with a sign or digit inside: a mark or digit with letters on both sides
    letter = ((_LOWER[data] >= 97) & (_LOWER[data] <= 122)) | (data >= 128)
    odd = (_MARKS[data] | ((data >= 48) & (data <= 57))) & (data != 39) & (data != 44)
    inside = np.zeros(len(data), bool)
    if len(data) > 2:
        inside[1:-1] = odd[1:-1] & letter[:-2] & (letter[2:] | odd[2:])
    inside &= np.append(byte_rows[1:] == byte_rows[:-1], False) if len(data) else inside
    hidden = np.zeros(n)
    for row in np.flatnonzero(at(inside) > 0):  # few texts have any; then the words are looked at one by one
        hidden[row] = sum(_revealed(w) for w in {*_ODD.findall(data[offsets[row] : offsets[row + 1]].tobytes())})
    hidden += _drawn_out(data, offsets)
    columns = [total(rows[learned]) / n_words, np.minimum(total(rows[learned]), 50), total(rows, weight) / n_words, top, np.minimum(total(rows[learned & near]), 20)]
    columns += [total(rows[bad]) / n_words, np.minimum(total(rows[bad]), 20), hidden / n_words, np.minimum(hidden, 20), np.minimum(total(rows[bad & near]), 20), total(rows[you]) / n_words]
    columns += [at(upper) / letters, total(rows[shouted]) / n_words, at((data == 33) | (data == 63)) / chars, at(_MARKS[data] & (data != 46) & (data != 44)) / chars, at(inside) / n_words, np.log1p(n_words)]
    return np.stack(columns, 1) if n else np.zeros((0, len(NAMES)))


class Rule:
    """Where there are no labels to learn from."""

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x[:, NAMES.index("lexicon_count")] + x[:, NAMES.index("disguised_count")]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        return np.where(s > 0, 0.9, 0.05)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


Model = tuple[Trees | Rule, Isotonic | Rule, Lexicon]


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, kind, n): in how many texts of a kind, which is 2 * fold + label, a term stands."""
    for batch in pieces(batches):
        data, offsets = flat(batch.column("text"))
        hashes, rows, starts, ends = words(data, offsets)
        terms, owner = _terms(data, hashes, starts, ends)
        kind = batch.column("fold").to_numpy() * 2 + batch.column("toxic").to_numpy()
        row = rows[owner]
        order = np.lexsort((terms, row))
        terms, row = terms[order], row[order]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (row[1:] != row[:-1])
        terms, kind = terms[new], kind[row[new]]
        for k in np.unique(kind):
            found, many = np.unique(terms[kind == k], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(np.full(len(found), k, np.int64)), pa.array(many.astype(np.int64))], ["term", "kind", "n"])


def _weighed(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Lower bounds of log-odds of terms, from the numbers of texts they stand in."""
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)) - 1.5 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def lexicons(picked: DataFrame) -> list[Lexicon]:
    """Lexicons learned without each fold of picked (toxic, text, fold), and at last the one of all folds. TERMS at most are kept, the heaviest."""
    sizes = {(r[0], r[1]): r[2] for r in picked.groupBy("fold", "toxic").count().collect()}
    n = np.array([[sizes.get((f, t), 0) for t in (0, 1)] for f in range(FOLDS)], float)
    counts = picked.select("fold", "toxic", "text").mapInArrow(_tallied, "term long, kind long, n long")
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}")
    toxic, clean = (sum((F.col(f"k{2 * f + t}") for f in range(1, FOLDS)), F.col(f"k{t}")) for t in (1, 0))
    odds = F.log((toxic + 0.5) / (n[:, 1].sum() + 1)) - F.log((clean + 0.5) / (n[:, 0].sum() + 1)) - 1.5 * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    kept = counts.groupBy("term").agg(*[of(k) for k in range(2 * FOLDS)]).where((toxic >= LEAST) & (odds >= MINIMUM)).orderBy(odds.desc(), "term").limit(TERMS).collect()
    if not kept:
        return [NOTHING] * (FOLDS + 1)
    term = np.array([r[0] for r in kept], np.int64).view(np.uint64)
    k = np.array([list(r[1:]) for r in kept], float).reshape(len(kept), FOLDS, 2)
    out = []
    for f in range(FOLDS + 1):
        others = [g for g in range(FOLDS) if g != f]
        seen, total = k[:, others].sum(1), n[others].sum(0)
        weight = _weighed(seen[:, 1], seen[:, 0], total[1], total[0])
        good = np.flatnonzero((seen[:, 1] >= LEAST) & (weight >= MINIMUM))
        good = good[np.argsort(term[good])]
        out.append((term[good], weight[good]))
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trees, their calibration and the learned lexicon, from sample labelled rows at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    tables = Stored(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    own = light(docs).select("doc_id", text.alias("text"), F.pmod(F.xxhash64(F.substring(text, 1, 48), F.lit(5)), F.lit(FOLDS)).cast("int").alias("fold"), F.xxhash64(text).alias("h"))
    own = own.join(F.broadcast(chosen), "doc_id")  # at most sample rows of two numbers
    picked = tables.put("toxicity-sample", own.dropDuplicates(["h", "toxic"])).repartition(PARTS, "h")  # few bytes, but much work on each
    learned = lexicons(picked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fold, x = batch.column("fold").to_numpy(), np.zeros((batch.num_rows, len(NAMES)))
            for f in np.unique(fold):
                x[fold == f] = features(batch.column("text").filter(pa.array(fold == f)), learned[f])
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), values], ["h", "toxic", "x"])

    rows = sorted(picked.select("h", "toxic", "fold", "text").mapInArrow(run, "h long, toxic int, x array<double>").collect())
    tables.drop("toxicity-sample")
    y = np.array([r[1] for r in rows], float)
    if len(rows) < 30 or not 0 < y.sum() < len(y):
        return Rule(), Rule(), NOTHING
    x, third = np.array([r[2] for r in rows]), np.arange(len(rows)) % 3 == 0
    if not (0 < y[third].sum() < third.sum() and 0 < y[~third].sum() < (~third).sum()):
        return Rule(), Rule(), NOTHING
    trees = Trees().fit(x[~third], y[~third])
    return trees, Isotonic().fit(trees.raw(x[third]), y[third]), learned[-1]


def scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    trees, scale, lexicon = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            raw = trees.raw(features(batch.column("text"), lexicon))
            # the raw score breaks ties within a calibrated step without leaving it
            score = np.clip(scale(raw) + 1e-6 * np.tanh(raw / 8), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(scorer(fit(docs, labels, sample)), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those predicted toxic; all columns and repeated rows stay. Flags travel with the rows, so nothing is joined."""
    run = scorer(fit(docs, labels, sample))
    names = docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.zeros(batch.num_rows, bool)), batch.column("text")], ["doc_id", "held_out", "text"])
            for out in run(iter([rows])):
                yield batch.filter(pa.compute.equal(out.column("predicted"), 0))

    return docs.select(names).mapInArrow(kept, docs.schema)
