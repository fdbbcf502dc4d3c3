"""Quality rules with host-level verdicts.

Every document is measured; rules that it fails are counted by host. A host's failure rate is
shrunk towards all hosts' by an empirical beta prior (fitted to the hosts' rates by moments), so
that a host with two documents isn't judged by them alone. Hosts whose shrunk rate is above the
limit are rejected, and their verdict is joined back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .frames import map_texts
from .kernels import NOT_SPACE, chunks, grams, mix, owners, prefix, slice_hash, words

SYMBOL = np.zeros(256, dtype=np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
STARTS_CHAR = np.ones(256, dtype=np.int64)  # bytes that begin a code point
STARTS_CHAR[0x80:0xC0] = 0
WINDOW = 8
MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    _, inverse, times = np.unique(keys, return_inverse=True, return_counts=True)
    return times[inverse] > 1


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array]:
    """The measures of each text; see ``documents_measured``."""
    out = np.zeros((5, len(offs) - 1), np.int64)
    for i, j, buf, local in chunks(data, offs):
        starts, ends, first = words(buf, local, NOT_SPACE)
        owner, sums = owners(first), prefix(buf)
        h = slice_hash(sums, starts, ends)
        out[0, i:j] = np.diff(first)
        out[1, i:j] = _sums(STARTS_CHAR[buf] * NOT_SPACE[buf], local)
        out[2, i:j] = _sums(SYMBOL[buf], local)
        # lines that have a word and equal an earlier line of their text
        breaks = np.append(np.flatnonzero(buf == 10), len(buf))
        begins = np.unique(np.concatenate([breaks[:-1] + 1, local[:-1]]))
        begins = begins[begins < len(buf)]
        doc = np.searchsorted(local, begins, "right") - 1
        ends_line = np.minimum(breaks[np.searchsorted(breaks, begins)], local[doc + 1])
        worded = np.searchsorted(starts, ends_line) > np.searchsorted(starts, begins)
        begins, ends_line, doc = begins[worded], ends_line[worded], doc[worded]
        key = mix(slice_hash(sums, begins, ends_line) + doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        kept = np.unique(key, return_index=True)[1]
        out[3, i:j] = np.bincount(doc, minlength=j - i) - np.bincount(doc[kept], minlength=j - i)
        # words inside windows found twice or more
        n = len(h) - WINDOW + 1
        if n > 0:
            at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
            key = mix(grams(h, WINDOW)[at] + owner[at].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            at = at[_repeated(key)]
            edge = np.zeros(len(h) + 1, np.int64)
            edge[at] += 1
            edge[at + WINDOW] -= 1
            out[4, i:j] = np.bincount(owner[np.cumsum(edge)[:-1] > 0], minlength=j - i)
    return dict(zip(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], map(pa.array, out), strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


#: Rules of a document, as conditions on its measures; a document's failure is any of them.
RULES = {
    "short_or_repetitive": "n_words < 20 OR 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > word_chars",
    "duplicate_lines": "n_dup_lines > 0 AND 20 * n_dup_lines > n_words",
}


def host_verdicts(measured: DataFrame, *, host_col: str = "host", limit: float = 0.5) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and ``rejected``.

    The prior's mean m and variance v are those of the hosts' rates (each host counts once); its
    strength is m(1-m)/v - 1, at least 1; where rates don't vary or there is one host, it is 1.
    """
    failed = F.expr(" OR ".join(f"({r})" for r in RULES.values()))
    hosts = measured.groupBy(host_col).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("bigint")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(F.avg("rate").alias("m"), F.var_pop("rate").alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(1.0)
    shrunk = (F.col("n_failed") + F.col("m") * strength) / (F.col("n_docs") + strength)
    # the prior is one row
    return hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", shrunk).select(host_col, "n_docs", "n_failed", "shrunk_rate", (F.col("shrunk_rate") > limit).alias("rejected"))


def apply_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = 0.5) -> DataFrame:
    """Each document's measures, ``base_failed``, its host's shrunk rate, and ``kept``.

    Null and empty texts have no words and fail; null hosts are one host. Repeated rows are judged
    each. Texts are measured once: the measures, a few numbers a row, are written and read twice.
    """
    narrow = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host")).alias("of"), F.col(text_col).alias("text"))
    measured = cut(map_texts(narrow, measure, MEASURES, id_col="of").select("doc_id.*", *[c.split()[0] for c in MEASURES.split(", ")]))
    verdicts = host_verdicts(measured, limit=limit).select(F.col("host").alias("h2"), "shrunk_rate", "rejected")
    return measured.join(verdicts, F.expr("host <=> h2")).select(
        "doc_id", *[c.split()[0] for c in MEASURES.split(", ")], base_failed().alias("base_failed"), (~base_failed() & ~F.col("rejected")).alias("kept"), F.col("shrunk_rate").alias("host_rate")
    )
