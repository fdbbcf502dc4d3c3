"""Brown class-based bigram model: exchange clustering, class transitions, word emissions.

Words are hashed to 64 bits. The clustering has two steps. The exchange proper works on one matrix of
bounded size: its units are the ``frequent`` most frequent words, each by itself, and all other words in
``endings`` groups by their last three bytes; each unit moves to the class that raises the likelihood
most, until a sweep moves few. Then every other word of the training text, however rare, gets the class
of its own: by hash bucket, its bigrams with the classes around it meet, and it goes where they are
likeliest. Transitions and sizes of the classes are counted anew from all words' final classes.
So what is gathered from the corpus grows with its vocabulary, distributed, and only class tables
and the frequent words are broadcast.

Counts of words, tokens and types cover the whole training text: they meet by hash bucket,
packed, and go back to the blocks of documents that ask, so no table of words is held in one
place. P(word | previous) = P(class | previous class) * P(word | class): transitions are smoothed
with the classes' own shares, emissions by adding one; an unknown word is one more word, in a
class of its own, as likely as words seen once are among the training tokens. A text ends with an end token, which is also the context of its first word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .kernels import LOWER, NOT_SPACE, chunks, owners, prefix, slice_hash, spans, words
from .packed import EMPTY, block_plan, find, in_blocks, packed, planes, rows_of, unpacked

END = np.uint64(0xE5D0E5D0E5D0E5D1)
PAIRS = 1 << 16  # words' contexts weighed at once
NO_CLASS = 255


def _tokens(buf: np.ndarray, offs: np.ndarray, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, endings and texts of all tokens, each text's end token after its words."""
    low = LOWER[buf]
    starts, ends, first = words(low, offs, NOT_SPACE)
    sums, n = prefix(low), len(offs) - 1
    name = np.insert(slice_hash(sums, starts, ends), first[1:], END)
    ending = slice_hash(sums, np.maximum(starts, ends - 3), ends) % np.uint64(endings)
    return name, np.insert(ending.astype(np.int64), first[1:], 0), np.insert(owners(first), first[1:], np.arange(n))


def _counted(names: list[np.ndarray], counts: list[np.ndarray], endings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each name once, with its summed count and its ending."""
    name, count, ending = (np.concatenate(x) for x in (names, counts, endings))
    order = np.argsort(name, kind="stable")
    name = name[order]
    at = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])) if len(name) else np.zeros(0, np.int64)
    return name[at], np.add.reduceat(count[order], at) if len(at) else count, ending[order][at]


class Counter:
    """Training counts of names, summed up as texts come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(EMPTY, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.size = 0

    def add(self, name: np.ndarray, ending: np.ndarray, trained: np.ndarray) -> None:
        self.parts.append(_counted([name], [trained.astype(np.int64)], [ending]))
        self.size += len(self.parts[-1][0])
        if self.size > 1 << 20:
            self.parts = [self.result()]
            self.size = len(self.parts[0][0]) // 2

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _counted(*(list(x) for x in zip(*self.parts, strict=True)))


def _words_of_scan(buckets: int, endings: int):
    """(bucket, names, counts, endings) of the training words of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trained = ~batch.column(1).to_numpy(zero_copy_only=False)
            seen = Counter()
            for i, j, buf, offs in chunks(*spans(batch.column(0))):
                name, ending, text = _tokens(buf, offs, endings)
                own = trained[i:j][text]
                seen.add(name[own], ending[own], np.ones(int(own.sum()), bool))
            name, count, ending = seen.result()
            out = packed(0, (name % np.uint64(buckets)).astype(np.int64), buckets, names=name, counts=count, endings=ending.astype(np.uint16))
            yield from out.select(["bucket", "names", "counts", "endings"]).to_batches()

    return run


def _bucket_totals(frequent: int, endings: int):
    def run(table: pa.Table) -> pa.Table:
        name, count, ending = _counted([unpacked(table, "names")], [unpacked(table, "counts", np.int64)], [unpacked(table, "endings", np.uint16).astype(np.int64)])
        top = np.lexsort((name, -count))[:frequent]
        types = np.bincount(ending[name != END], minlength=endings).astype(np.int64)
        ends = int(count[name == END].sum())
        return pa.table(
            {
                "tops": pa.array([[{"name": n, "count": c, "ending": e} for n, c, e in zip(name[top].view(np.int64).tolist(), count[top].tolist(), ending[top].tolist(), strict=True)]], TOP),
                "types": pa.array([types.tolist()], pa.list_(pa.int64())),
                "ends": pa.array([ends], pa.int64()),
                "once": pa.array([int((count == 1).sum())], pa.int64()),
            }
        )

    return run


TOP = pa.list_(pa.struct([("name", pa.int64()), ("count", pa.int64()), ("ending", pa.int64())]))


def _units(name: np.ndarray, ending: np.ndarray, frequent: np.ndarray, endings: int) -> np.ndarray:
    """Unit of each token: its rank among the sorted frequent names, else its ending's; the end token's is last."""
    known, at = find(frequent, name)
    unit = np.where(known, at, len(frequent) + ending)
    return np.where(name == END, len(frequent) + endings, unit)


def _cells(total: np.ndarray) -> pa.RecordBatch:
    """The cells of a flat matrix of counts that aren't zero."""
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def _unit_bigrams(shared, endings: int):
    """Counts of unit bigrams of a partition's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value
        size = len(frequent) + endings + 1
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            trained = ~batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, buf, offs in chunks(*spans(batch.column(0))):
                name, ending, text = _tokens(buf, offs, endings)
                own = trained[i:j][text]
                unit = _units(name[own], ending[own], frequent, endings)
                if len(unit):  # a text's first word follows the end before it
                    total += np.bincount(np.concatenate([[size - 1], unit[:-1]]) * size + unit, minlength=size * size)
        yield _cells(total)

    return run


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    """The sums of all partitions' cells (at most size * size rows) as a matrix."""
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int, sweeps: int = 12) -> np.ndarray:
    """The class of each unit; the last unit (the end) keeps the last class to itself."""
    n = len(bigrams)
    left, right = bigrams.sum(1).astype(float), bigrams.sum(0).astype(float)
    order = np.lexsort((np.arange(n - 1), -right[: n - 1]))
    label = np.full(n, classes - 1)
    label[order] = np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), label] = 1
    after, before = bigrams @ member, bigrams.T @ member  # of a unit with the classes after and before it
    table = member.T @ after
    out_of, into = member.T @ left, member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = label[u], float(bigrams[u, u])
            f, b = after[u].copy(), before[u].copy()
            f[a] -= own
            b[a] -= own
            table[a] -= f
            table[:, a] -= b
            table[a, a] -= own
            out_of[a] -= left[u]
            into[a] -= right[u]
            diagonal = np.diagonal(table)
            gain = (_xlogx(table + f) - _xlogx(table)).sum(1) - _xlogx(diagonal + f) + _xlogx(diagonal)
            gain += (_xlogx(table.T + b) - _xlogx(table.T)).sum(1) - _xlogx(diagonal + b) + _xlogx(diagonal)
            gain += _xlogx(diagonal + f + b + own) - _xlogx(diagonal)
            gain -= _xlogx(out_of + left[u]) - _xlogx(out_of) + _xlogx(into + right[u]) - _xlogx(into)
            to = int(np.argmax(gain[:-1]))
            if gain[a] >= gain[to] - 1e-9:
                to = a
            table[to] += f
            table[:, to] += b
            table[to, to] += own
            out_of[to] += left[u]
            into[to] += right[u]
            if to != a:
                moved += 1
                label[u] = to
                for m, w in ((after, bigrams[:, u]), (before, bigrams[u])):
                    m[:, a] -= w
                    m[:, to] += w
        if moved * 200 < n:
            break
    return label


class Model:
    """What scoring needs beside the words' own counts; its size depends on the parameters only."""

    def __init__(self, frequent: np.ndarray, top_counts: np.ndarray, top_endings: np.ndarray, types: np.ndarray, ends: int, once: int, bigrams: np.ndarray, classes: int, alpha: float):
        self.frequent, self.endings = frequent, len(types)
        self.label = exchange(bigrams, classes)
        units = len(bigrams)
        self.train_tokens = int(bigrams.sum())
        tail_types = types - np.bincount(top_endings, minlength=len(types))
        unit_types = np.concatenate([np.ones(len(frequent), np.int64), tail_types, [1 if ends else 0]])
        self.vocabulary = int(unit_types.sum())
        member = np.zeros((units, classes))
        member[np.arange(units), self.label] = 1
        self.classes, self.alpha = classes, alpha
        self.new = (once + 1) / (self.train_tokens + 2)  # how often a token is the first of its word, from the words seen once
        self.unknown = classes
        self.tables(member.T @ bigrams @ member, member.T @ unit_types)

    def tables(self, steps: np.ndarray, kinds: np.ndarray) -> None:
        """Smoothed transitions and sizes from the bigrams of classes and the number of words of each."""
        size = steps.sum(0)
        share = (size + kinds) / max(1, self.train_tokens + self.vocabulary)
        wide = np.zeros((self.classes + 1, self.classes))  # the last context: an unknown word, after which classes have their shares
        wide[: self.classes] = steps
        step = (wide + self.alpha * share) / (wide.sum(1, keepdims=True) + self.alpha)
        self.log_step = np.log10(np.append(step * (1 - self.new), np.full((self.classes + 1, 1), self.new), 1) + 1e-300)
        self.log_size = np.append(np.log10(np.maximum(size + kinds, 1)), 0)

    def labels(self, names: np.ndarray, assigned: np.ndarray) -> np.ndarray:
        """Classes of training words: those of the exchange, else the word's own."""
        known, at = find(self.frequent, names)
        out = assigned.astype(np.int64)
        out[known] = self.label[at[known]]
        out[names == END] = self.label[-1]
        return out


def _fit(texts: DataFrame, buckets: int, frequent: int, endings: int, classes: int, alpha: float) -> Model:
    """``texts``: text, held_out."""
    spark = texts.sparkSession
    totals = texts.mapInArrow(_words_of_scan(buckets, endings), "bucket int, names binary, counts binary, endings binary").groupBy("bucket")
    totals = totals.applyInArrow(_bucket_totals(frequent, endings), "tops array<struct<name: bigint, count: bigint, ending: bigint>>, types array<bigint>, ends bigint, once bigint").cache()
    try:
        # as many rows as buckets become one for each ending, and the most frequent words
        top = totals.select(F.explode("tops").alias("t")).select("t.*").where(F.col("name") != int(END.view(np.int64))).orderBy(F.desc("count"), "name").limit(frequent).collect()
        types = {r[0]: r[1] for r in totals.select(F.posexplode("types")).groupBy("pos").agg(F.sum("col")).collect()}
        ends, once = (x or 0 for x in totals.agg(F.sum("ends"), F.sum("once")).first())
    finally:
        totals.unpersist()
    names = np.array([r[0] for r in top], np.int64).view(np.uint64)
    order = np.argsort(names)
    known = spark.sparkContext.broadcast(names[order])
    bigrams = _matrix(texts.mapInArrow(_unit_bigrams(known, endings), "cell bigint, n bigint"), len(names) + endings + 1)
    counts, ending = np.array([r[1] for r in top], np.int64), np.array([r[2] for r in top], np.int64)
    return Model(names[order], counts[order], ending[order], np.array([types.get(e, 0) for e in range(endings)], np.int64), ends, once, bigrams, classes, alpha)


def _contexts(shared, buckets: int):
    """By bucket: words that the exchange has not clustered themselves, each with the classes around it and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            trained = ~batch.column(1).to_numpy(zero_copy_only=False)
            names, around = [EMPTY], [np.zeros(0, np.int64)]
            for i, j, buf, offs in chunks(*spans(batch.column(0))):
                name, ending, text = _tokens(buf, offs, model.endings)
                own = trained[i:j][text]
                name = name[own]
                unit = _units(name, ending[own], model.frequent, model.endings)
                label = np.concatenate([model.label[-1:], model.label[unit], model.label[-1:]])
                rare = (unit >= len(model.frequent)) & (name != END)
                names.append(name[rare])
                around.append((label[:-2] * model.classes + label[2:])[rare])
            name, context, times = _pairs(np.concatenate(names), np.concatenate(around), None)
            word, begin = np.unique(name, return_index=True)
            of_word = (word % np.uint64(buckets)).astype(np.int64)
            lengths = np.diff(np.append(begin, len(name)))
            out = packed(0, of_word, buckets, names=word, lengths=lengths.astype(np.uint32))
            pairs = packed(0, np.repeat(of_word, lengths), buckets, contexts=context.astype(np.uint16), counts=times.astype(np.uint32))
            yield from pa.table({**{c: out[c] for c in ("bucket", "names", "lengths")}, **{c: pairs[c] for c in ("contexts", "counts")}}).to_batches()

    return run


def _pairs(name: np.ndarray, context: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word and context once, in order, with the summed counts."""
    order = np.lexsort((context, name))
    name, context = name[order], context[order]
    new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (context[1:] != context[:-1])])) if len(name) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(name))) if times is None else np.add.reduceat(times[order], new) if len(new) else times
    return name[new], context[new], sums


def assign(model: Model, name: np.ndarray, context: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, classes, tokens): each word goes to the class under which its bigrams are likeliest, never to the end's."""
    name, context, times = _pairs(name, context, times)
    words, begin = np.unique(name, return_index=True)
    tokens = np.add.reduceat(times, begin) if len(words) else np.zeros(0, np.int64)
    out = np.zeros(len(words), np.uint8)
    into, on = model.log_step[: model.classes, : model.classes], model.log_step[: model.classes, : model.classes].T
    cuts = np.append(begin, len(name))
    at = 0
    while at < len(words):  # a word has at most classes * classes contexts
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PAIRS, "right")) - 1)
        some = slice(cuts[at], cuts[to])
        how = (into[context[some] // model.classes] + on[context[some] % model.classes]) * times[some, None]
        fit = np.add.reduceat(how, cuts[at:to] - cuts[at]) - tokens[at:to, None] * model.log_size[None, : model.classes]
        fit[:, model.label[-1]] = -np.inf
        out[at:to] = fit.argmax(1)
        at = to
    return words, out, tokens


def _assigned(shared):
    def run(table: pa.Table) -> pa.Table:
        model: Model = shared.value
        name = np.repeat(unpacked(table, "names"), unpacked(table, "lengths", np.uint32))
        words, label, _ = assign(model, name, unpacked(table, "contexts", np.uint16).astype(np.int64), unpacked(table, "counts", np.uint32).astype(np.int64))
        kinds = np.bincount(label, minlength=model.classes).tolist()
        return pa.table({"bucket": table["bucket"].slice(0, 1), "names": pa.array([planes(words)], pa.binary()), "labels": pa.array([planes(label)], pa.binary()), "kinds": pa.array([kinds], pa.list_(pa.int64()))})

    return run


def _asked(buckets: int):
    """The names of a block and their training counts in it."""

    def run(table: pa.Table) -> pa.Table:
        name, count, _ = _block_words(table)
        return packed(table["block"][0].as_py(), (name % np.uint64(buckets)).astype(np.int64), buckets, names=name, counts=count)

    return run


def _block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    trained = ~table["held_out"].to_numpy()
    seen = Counter()
    for i, j, buf, offs in chunks(*spans(table["text"])):
        name, ending, text = _tokens(buf, offs, 1)
        seen.add(name, ending, trained[i:j][text])
    return seen.result()


def _answered(table: pa.Table, assigned: pa.Table) -> pa.Table:
    """The corpus's counts and the words' own classes, in the order in which each block asked."""
    if not len(table):
        return pa.table({"block": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "counts": pa.array([], pa.binary()), "labels": pa.array([], pa.binary())})
    name, count, row = unpacked(table, "names"), unpacked(table, "counts", np.int64), rows_of(table, "names", 8)
    names, total, _ = _counted([name], [count], [np.zeros(len(name), np.int64)])
    total = total[np.searchsorted(names, name)]
    has, at = find(unpacked(assigned, "names"), name)
    label = np.full(len(name), NO_CLASS, np.uint8)
    label[has] = unpacked(assigned, "labels", np.uint8)[at[has]]
    cut = list(zip(*[iter(np.repeat(np.searchsorted(row, np.arange(len(table) + 1)), 2)[1:-1].tolist())] * 2, strict=True))
    return pa.table({"block": table["block"], "bucket": table["bucket"], **{c: pa.array([planes(v[a:b]) for a, b in cut], pa.binary()) for c, v in (("counts", total), ("labels", label))}})


def _known(table: pa.Table, answers: pa.Table, model: Model, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words, their training counts, and their classes (that of unknown words without a count)."""
    names, _, _ = _block_words(table)
    order = np.argsort((names % np.uint64(buckets)).astype(np.int64), kind="stable")
    answers = answers.sort_by("bucket")
    counts, labels = np.zeros(len(names), np.int64), np.zeros(len(names), np.uint8)
    counts[order], labels[order] = unpacked(answers, "counts", np.int64), unpacked(answers, "labels", np.uint8)
    return names, counts, np.where(counts > 0, model.labels(names, labels), model.unknown)


def _transitions(shared, buckets: int):
    """Counts of class bigrams of a block's training texts."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        total = np.zeros(model.classes**2, np.int64)
        if len(table):
            names, _, labels = _known(table, answers, model, buckets)
            trained = ~table["held_out"].to_numpy()
            for i, j, buf, offs in chunks(*spans(table["text"])):
                name, _, text = _tokens(buf, offs, 1)
                label = labels[np.searchsorted(names, name[trained[i:j][text]])]
                if len(label):
                    total += np.bincount(np.concatenate([model.label[-1:], label[:-1]]) * model.classes + label, minlength=len(total))
        return pa.Table.from_batches([_cells(total)])

    return run


def _scored(shared, buckets: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        model: Model = shared.value
        names, counts, labels = _known(table, answers, model, buckets)
        n, v = model.train_tokens, model.vocabulary
        out: dict[str, list[np.ndarray]] = {c: [] for c in ("n_tokens", "n_known", "base_score", "score")}
        for i, j, buf, offs in chunks(*spans(table["text"])):
            name, _, text = _tokens(buf, offs, 1)
            at = np.searchsorted(names, name)
            c, label = counts[at], labels[at]
            past = np.concatenate([[model.label[-1]], label[:-1]])
            past[np.concatenate([[True], text[1:] != text[:-1]])] = model.label[-1]
            step = model.log_step[past, label] + np.where(c > 0, np.log10(c + 1) - model.log_size[label], 0)
            out["n_tokens"].append(np.bincount(text, minlength=j - i))
            out["n_known"].append(np.bincount(text[c > 0], minlength=j - i))
            out["base_score"].append(np.bincount(text, np.log10((c + 1) / (n + 1 * (v + 1))), j - i))
            out["score"].append(np.bincount(text, step, j - i))
        columns = {k: pa.array(np.concatenate(x)) for k, x in out.items()}
        columns["perplexity"] = pa.array(10 ** np.minimum(300, -np.concatenate(out["score"]) / np.concatenate(out["n_tokens"])))
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "train_tokens": pa.array(np.full(len(table), n)), **columns})

    return run


def score_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    fold: int = 2,
    frequent: int = 768,
    endings: int = 256,
    classes: int = 64,
    alpha: float = 64.0,
) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows whose crc32(id as text) modulo ``folds`` is not ``fold``. ``score`` is the
    log10 probability of the text with its end; ``base_score`` that of single tokens, adding one.
    Null texts are empty (the end only); a null id is in no fold and is learnt from. Repeated rows
    count and are scored each; with nothing to learn from, all words are unknown; an empty table
    gives no rows. ``classes`` is at most 255. Other columns are not read.
    """
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out.alias("held_out"))
    blocks, buckets = block_plan(rows)
    context = rows.sparkSession.sparkContext
    trained = rows.select("text", "held_out")
    model = _fit(trained, buckets, frequent, endings, classes, alpha)
    first = context.broadcast(model)
    found = trained.mapInArrow(_contexts(first, buckets), "bucket int, names binary, lengths binary, contexts binary, counts binary")
    own = stored(found.groupBy("bucket").applyInArrow(_assigned(first), "bucket int, names binary, labels binary, kinds array<bigint>"))
    held = in_blocks(rows, blocks).groupBy("block")
    asked = held.applyInArrow(_asked(buckets), "bucket int, block int, names binary, counts binary").groupBy("bucket")
    answers = stored(asked.cogroup(own.groupBy("bucket")).applyInArrow(_answered, "block int, bucket int, counts binary, labels binary"))
    # the classes' tables anew, from all words' classes
    kinds = np.zeros(classes)
    kinds[model.label[-1]] = 1
    np.add.at(kinds, model.label[: len(model.frequent)], 1)
    for c, n in own.select(F.posexplode("kinds")).groupBy("pos").agg(F.sum("col")).collect():
        kinds[c] += n
    steps = held.cogroup(answers.groupBy("block")).applyInArrow(_transitions(first, buckets), "cell bigint, n bigint")
    model.tables(_matrix(steps, classes), kinds)
    shared = context.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return held.cogroup(answers.groupBy("block")).applyInArrow(
        _scored(shared, buckets), f"doc_id {id_type}, held_out boolean, train_tokens bigint, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    )
