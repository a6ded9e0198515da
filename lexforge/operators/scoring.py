"""Scores of a block of queries against batches of documents, as matrix products inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries of one product; most terms of one; share of its cells that a term has to fill to be worth a column; pairs added at once for the others.
CHUNK, COLUMNS, FILLED, PAIRS = 512, 2048, 0.002, 4_000_000
#: Documents of a batch that set its first bars, those with most terms; parts of the others, by their number of terms.
LARGEST, PARTS = 512, 4


def half_up(x: np.ndarray, decimals: int) -> np.ndarray:
    """Spark's round: half up on the shortest decimal form of each number."""
    y = x * 10.0**decimals
    whole = np.floor(y + 0.5)
    near = np.abs(y - np.floor(y) - 0.5) < 1e-4
    if near.any():
        values, at = np.unique(x[near], return_inverse=True)
        unit = Decimal(1).scaleb(-decimals)
        exact = [int(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP).scaleb(decimals)) for v in values.tolist()]
        whole[near] = np.array(exact, dtype=np.float64)[at]
    return whole / 10.0**decimals


def _add_rare(sums: np.ndarray, query: np.ndarray, term: np.ndarray, weight: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> None:
    """Adds weight * impact for each (query, term) and each document of the term, some PAIRS at a time."""
    n = count[term]
    query, term, weight, n = query[n > 0], term[n > 0], weight[n > 0], n[n > 0]
    ends = np.cumsum(n)
    if not len(ends):
        return
    edges = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PAIRS), side="right"), len(ends)))
    for a, b in zip(np.append(0, edges), edges):
        m = n[a:b]
        pos = np.arange(m.sum()) + np.repeat(start[term[a:b]] - (np.cumsum(m) - m), m)
        np.add.at(sums.reshape(-1), np.repeat(query[a:b] * sums.shape[1], m) + doc[pos], np.repeat(weight[a:b], m) * impact[pos])


#: Impacts that are sums of whole numbers: 1, and 1 + tf / length. Any other is a function of tf and length.
ONE, SHARE = "one", "share"


def _table(of: np.ndarray, doc: np.ndarray, held: np.ndarray, asked: np.ndarray, n: int, docs: int) -> tuple:
    """Impacts by term and document: those of frequent terms as a matrix, the others by where each term's documents start."""
    start = np.searchsorted(of, np.arange(len(asked) + 1))
    count = np.diff(start)
    filled = count * asked
    most = np.argsort(-filled, kind="stable")[:COLUMNS]
    most = most[filled[most] >= FILLED * n * docs]
    column = np.full(len(asked), -1)
    column[most] = np.arange(len(most))
    frequent = column[of] >= 0
    right = np.zeros((len(most), docs), held.dtype)
    right[column[of[frequent]], doc[frequent]] = held[frequent]
    return column, right, start, count, doc, held


def _product(table: tuple, queries: int, query: np.ndarray, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums of weight * impact of each query and document."""
    column, right, start, count, doc, held = table
    dense = column[term] >= 0
    left = np.zeros((queries, len(right)), held.dtype)
    left[query[dense], column[term[dense]]] = weight[dense]
    sums = left @ right
    _add_rare(sums, query[~dense], term[~dense], weight[~dense].astype(held.dtype), start, count, doc, held)
    return sums


def searcher(weighted: pa.Table, impacts: Sequence[Callable | str], k: int, decimals: int) -> Callable:
    """A function for mapInArrow over (id, lower-case text) with the best k of each query in each batch, less those below the best k of batches
    before; `list` is the impact's place in `impacts`.

    A document that holds m of a query's terms scores no more than the m heaviest do. For lists of which that is the bound, a batch is taken in
    parts, documents with most terms first, and a part is only multiplied with the queries whose best k it may enter.

    `weighted`: query_id, query_length, divisor, term, weight, all weights and impacts above zero. Whole numbers are summed in single precision
    where that is exact (below 2^24), all others in double precision. The sum of weight * (1 + tf / length) is one + (one + more) / length with
    the sums of weight and of weight * (tf - 1), which are whole and share their matrices with the first list.
    """
    weighted = weighted.sort_by([("query_id", "ascending"), ("query_length", "ascending"), ("weight", "descending")]).combine_chunks()
    ids, per = weighted["query_id"], weighted["divisor"].to_numpy().astype(np.float64)
    length, weight = weighted["query_length"].to_numpy(), weighted["weight"].to_numpy()
    coded = weighted["term"].combine_chunks().dictionary_encode() if len(weighted) else pa.array([], pa.string()).dictionary_encode()
    vocabulary, term = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    place = ids.combine_chunks().dictionary_encode().indices.to_numpy() if len(weighted) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(length) != 0))[: len(place)])
    names, per, bounds = ids.take(pa.array(starts)).combine_chunks(), per[starts], np.append(starts, len(term))
    n, size, terms = len(starts), len(vocabulary), np.diff(bounds)
    row_of, heaviest = np.repeat(np.arange(n), terms), np.append(0, np.cumsum(weight))
    norms, bounded = np.sqrt(np.bincount(row_of, weight**2, n)), all(x in (ONE, SHARE) for x in impacts)
    whole = bool(n) and (weight % 1 == 0).all()
    kind = np.float32 if whole and np.add.reduceat(weight, starts).max() < 2**24 else np.float64
    unit = 10.0**-decimals

    def low_of(bar: np.ndarray, asks: np.ndarray, off: float) -> np.ndarray:
        """Sums that may be among the best k, where the k-th score is `bar` and sums are off by a share of `off`."""
        return (bar - unit) * per[asks] * (1 - off)

    def within(most: int, size: float, tops: np.ndarray) -> np.ndarray:
        """The queries of which a document with `most` terms may enter a list's best k. The sum of weight * tf / length is no more than the heaviest
        weight, and than the product of the norms of weights and of tf / length, which is `size` at most."""
        if not bounded:
            return np.arange(n)
        reach = heaviest[bounds[:-1] + np.minimum(terms, most)] - heaviest[bounds[:-1]]
        may = np.zeros(n, bool)
        for impact, top in zip(impacts, tops):
            more = np.minimum(weight[starts], norms * size) if impact == SHARE else 0
            may |= (reach > 0) & (reach + more >= low_of(top[:, 0], np.arange(n), 1e-6))
        return np.flatnonzero(may)

    def best(of: np.ndarray, doc: np.ndarray, tf: np.ndarray, long: np.ndarray, queries: np.ndarray, tops: np.ndarray) -> Iterator[tuple]:
        """List, query, document and score of the queries' best k of some documents, which are numbered by id: ties keep that order."""
        docs = len(long)
        mine = np.isin(np.arange(n), queries)[row_of]
        mine_term, mine_weight, ends = term[mine], weight[mine], np.append(0, np.cumsum(terms[queries]))
        asked = np.bincount(mine_term, minlength=size)
        tables: dict = {}
        if ONE in impacts or SHARE in impacts:
            tables[ONE] = _table(of, doc, np.ones(len(of), kind), asked, len(queries), docs)
        if SHARE in impacts:
            more = tf > 1
            exact = kind if weight.max() * long.max() < 2**24 else np.float64
            tables[SHARE] = _table(of[more], doc[more], (tf[more] - 1).astype(exact), asked, len(queries), docs)
            inverse = (1 / np.maximum(long, 1)).astype(exact)
        for impact in impacts:
            if callable(impact):
                tables[impact] = _table(of, doc, impact(tf, long[doc]).astype(np.float64), asked, len(queries), docs)
        groups = min(docs, max(128, 8 * k))
        for a in range(0, len(queries), CHUNK):
            asks = queries[a : a + CHUNK]
            rows = slice(ends[a], ends[a + len(asks)])
            query = np.repeat(np.arange(len(asks)), terms[asks])
            products = {x: _product(table, len(asks), query, mine_term[rows], mine_weight[rows]) for x, table in tables.items()}
            for place_of, (impact, top) in enumerate(zip(impacts, tops)):
                if impact == SHARE:
                    sums = products[SHARE] + products[ONE]
                    sums *= inverse
                    sums += products[ONE]
                else:
                    sums = products[impact]
                bar = top[asks, 0]
                if groups >= k and not bar.all():  # the k-th of the groups' greatest sums is no more than the k-th sum
                    wide = docs // groups
                    most = sums[:, : groups * wide].reshape(len(asks), groups, wide).max(axis=2)
                    bar = np.maximum(bar, np.partition(most, groups - k, axis=1)[:, groups - k] / per[asks])
                low = low_of(bar, asks, 1e-6 if impact == SHARE else 1e-9)  # sums of a share are off by 3e-7 of them at most
                low = np.maximum(np.nextafter(low.astype(sums.dtype), sums.dtype.type(-np.inf)), np.finfo(sums.dtype).tiny)
                at = np.flatnonzero(sums >= low[:, None])
                q, d = np.divmod(at, docs)
                if impact == SHARE:
                    one, rest = (products[x].reshape(-1)[at].astype(np.float64) for x in (ONE, SHARE))
                    total = one + (one + rest) / long[d]
                else:
                    total = sums.reshape(-1)[at].astype(np.float64)
                value = half_up(total / per[asks][q], decimals)
                first = np.lexsort((d, -value, q))
                q, d, value = q[first], d[first], value[first]
                rank = np.arange(len(q)) - np.searchsorted(q, q)
                q, d, value, rank = (x[rank < k] for x in (q, d, value, rank))
                new = np.zeros((len(asks), k))
                new[q, rank] = value
                top[asks] = np.partition(np.hstack([top[asks], new]), k, axis=1)[:, k:]
                yield np.full(len(q), place_of, np.int32), asks[q], d, value

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = np.zeros((len(impacts), n, k))  # each query's best scores so far, the k-th first
        for batch in batches:
            docs, tokens = batch.num_rows, pc.utf8_split_whitespace(batch.column(1))
            if not docs or not n:
                continue
            order = pc.sort_indices(batch.column(0)).to_numpy()
            number = np.empty(docs, np.int64)
            number[order] = np.arange(docs)
            of_word = np.repeat(number.astype(np.int32), tokens.value_lengths().to_numpy())
            words = tokens.flatten().dictionary_encode()
            code = pc.index_in(words.dictionary, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int32 if size * docs < 2**31 else np.int64)
            blank = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)  # before and after outer white space
            words = words.indices.to_numpy()
            long = np.bincount(of_word, minlength=docs) - np.bincount(of_word[blank[words]], minlength=docs)
            code = code[words]
            key, tf = np.unique((code * docs + of_word)[code >= 0], return_counts=True)
            of, doc = np.divmod(key, docs)
            held = np.bincount(doc, minlength=docs)
            sizes = np.sqrt(np.bincount(doc, tf.astype(np.float64) ** 2, docs)) / np.maximum(long, 1)
            by_size = np.argsort(-held, kind="stable")
            edges = np.append(0, np.linspace(min(LARGEST, docs), docs, PARTS + 1).astype(int)) if bounded else np.array([0, docs])
            found: list = []
            for x, y in zip(edges, edges[1:]):
                if x == y or not len(queries := within(held[by_size[x]], sizes[by_size[x:y]].max(), tops)):
                    continue
                part = np.sort(by_size[x:y])
                place = np.full(docs, -1)
                place[part] = np.arange(y - x)
                inside = place[doc] >= 0
                for lists, q, d, value in best(of[inside], place[doc[inside]], tf[inside], long[part], queries, tops):
                    found.append((lists, q, order[part[d]], value))
            if found:
                lists, q, rows, values = (np.concatenate(x) for x in zip(*found))
                keep = values >= tops[lists, q, 0]
                yield pa.RecordBatch.from_arrays([pa.array(lists[keep]), names.take(pa.array(q[keep])), batch.column(0).take(pa.array(rows[keep])), pa.array(values[keep])], ["list", "query_id", "id", "score"])

    return search
