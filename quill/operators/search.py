"""Search over an index, for many searches at once: searches are rows, and one join to the postings scores them all.

searches: search_id, query, and optionally issuer, role, source (null: no filter), include_secondary.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions import scoring
from ..functions.text import normalize_space, runs, tokens
from ..sources.files import scratch
from .index import Index

SECONDARY = ("secondary_faq", "secondary_summary")
#: Search terms up to which they are broadcast to the postings.
BROADCAST_TERMS = 100_000
#: Different search terms up to which the postings' scan gets them as a filter.
PUSHED_TERMS = 1000
#: Documents times searches that are scored at once.
DENSE = 1 << 20
#: Query vectors that are multiplied at once with a batch of vectors.
PRODUCTS = 256


def search_terms(searches: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """(search_id, term, qf): repeated terms weigh by their number."""
    return searches.select("search_id", F.explode(tokens(F.col("query"), stopwords)).alias("term")).groupBy("search_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def candidates(terms: DataFrame, index: Index, most: int | None = scoring.MAX_CANDIDATE_TERMS, names: Sequence[str] | None = None) -> DataFrame:
    """search_terms with df, is_candidate (the rarest terms, unknown ones last, ties by the term; all of them if most is None)
    and min_match. names: the terms' names, if they are few."""
    known = terms.join(_named(index.terms, names), "term", "left")
    w = Window.partitionBy("search_id")
    rank = F.row_number().over(w.orderBy(F.coalesce("df", F.lit(10**9)), "term"))
    out = known.withColumn("is_candidate", F.lit(True) if most is None else rank <= most)
    return out.withColumn("min_match", F.when(F.count_if("is_candidate").over(w) >= scoring.MIN_MATCH_FROM_TERMS, scoring.MIN_MATCH).otherwise(1))


def _named(rows: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """Few names go to the scan as a filter: terms and postings lie sorted by term, so other row groups aren't read."""
    return rows.where(F.col("term").isin(list(names))) if names is not None and len(names) <= PUSHED_TERMS else rows


def held(rows: DataFrame) -> tuple[DataFrame, bool]:
    """Rows of the questions' size, computed once, and whether they are few enough to be broadcast; or else as they are."""
    got = rows.limit(BROADCAST_TERMS + 1).collect()
    return (rows.sparkSession.createDataFrame(got, rows.schema), True) if len(got) <= BROADCAST_TERMS else (rows, False)


def bm25(index: Index, searches: DataFrame, filters: Sequence[str] = (), stopwords: Sequence[str] = (), min_match: bool = True, scope: DataFrame | None = None, scope_key: str = "file_id", limit: int | None = None, most: int | None = scoring.MAX_CANDIDATE_TERMS) -> DataFrame:
    """(search_id, doc_id, matched, bm25) of the documents with enough of a search's `most` rarest terms, scored by all terms.
    most: None takes the documents with any of all its terms.

    Counts of terms, documents and lengths are those of the whole index, whatever the filters. scope: (search_id,
    scope_key) rows; a search with any there looks only at those. limit: top rows a search, ties by doc_id. Searches, terms
    and scopes that can be broadcast go to the postings, which are brought together by document; with more of them the
    documents and their postings are joined to the searches by shuffles.
    """
    asked, few = held(search_terms(searches, stopwords))
    names = sorted({r["term"] for r in asked.select("term").collect()}) if few else None
    terms, few = held(candidates(asked, index, most, names))
    pairs = None
    if scope is not None:
        pairs, small = held(scope.select("search_id", scope_key).distinct())
        few = few and small
    wanted = None
    if filters:
        wanted, small = held(searches.select("search_id", *filters))
        few = few and small
    if few:
        out = _by_document(index, terms, wanted, filters, min_match, pairs, scope_key, limit)
    else:
        out = _by_pair(index, terms, few_terms=False, wanted=wanted, filters=filters, min_match=min_match, scope=pairs, scope_key=scope_key)
    return top(out, "bm25", limit) if limit else out


def _by_pair(index: Index, terms: DataFrame, few_terms: bool, wanted: DataFrame | None, filters: Sequence[str], min_match: bool, scope: DataFrame | None, scope_key: str) -> DataFrame:
    """The hits by joins. The postings of the rarest terms give the documents first; the others' postings count only for
    those."""
    rare = terms.where("is_candidate")
    found = _postings(index, rare, few_terms).groupBy("search_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"), F.first("min_match").alias("_least"))
    if min_match:
        found = found.where("matched >= _least")
    cols = [*filters, *([scope_key] if scope is not None else [])]
    found = found.drop("_least").join(index.docs.select("doc_id", "doc_len", *cols), "doc_id")
    if wanted is not None:
        found = found.join(side(wanted.select("search_id", *[F.col(c).alias(f"_{c}") for c in filters])), "search_id")
        for c in filters:  # a null asks for nothing
            found = found.where(F.col(f"_{c}").isNull() | (F.col(f"_{c}") == F.col(c)))
    if scope is not None:
        scoped = scope.select("search_id").distinct().withColumn("_scoped", F.lit(True))
        inside = scope.select("search_id", scope_key).distinct().withColumn("_inside", F.lit(True))
        found = found.join(scoped, "search_id", "left").join(inside, ["search_id", scope_key], "left").where("_scoped IS NULL OR _inside")
    # the documents are found once: their number, and the join, come from what was written
    found = stored(found.select("search_id", "doc_id", "matched", "doc_len"))
    joined = _postings(index, terms, few_terms).join(side(found), ["search_id", "doc_id"])
    part = scoring.bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.greatest(F.col("doc_len"), F.lit(1)), F.col("avg_len"), F.col("qf"))
    scored = joined.crossJoin(F.broadcast(index.stats)).groupBy("search_id", "doc_id").agg(F.first("matched").alias("matched"), F.sum(part).alias("bm25"))  # stats: one row
    return scored.where("bm25 > 0")


def _numbered(rows: DataFrame, column: str, values: Sequence, kind: DataType, name: str) -> DataFrame:
    """rows with the number of the column's value among values, or null. values are few and broadcast."""
    table = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], StructType([StructField("_value", kind), StructField(name, IntegerType())]))
    return rows.join(F.broadcast(table), F.col(column) == F.col("_value"), "left").drop("_value")


def _by_document(index: Index, terms: DataFrame, wanted: DataFrame | None, filters: Sequence[str], min_match: bool, scope: DataFrame | None, scope_key: str, limit: int | None) -> DataFrame:
    """The hits, document by document: each posting of an asked term goes once, as numbers, to the task of its document,
    which scores all searches, so that no row is made for a term of a search in a document. limit: a task hands on that
    many hits of a search."""
    rows = [r for r in terms.collect() if r["df"] is not None]
    ids = sorted({r["search_id"] for r in rows}, key=repr)
    names = sorted({r["term"] for r in rows})
    search_at, term_at = {s: i for i, s in enumerate(ids)}, {t: i for i, t in enumerate(names)}
    rows.sort(key=lambda r: (term_at[r["term"]], search_at[r["search_id"]]))
    stats = index.stats.first()
    df, n_docs = np.array([r["df"] for r in rows], float), stats["n_docs"] or 0
    weight = np.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * np.array([r["qf"] for r in rows], float)
    starts = np.searchsorted(np.array([term_at[r["term"]] for r in rows], np.int64), np.arange(len(names) + 1))
    of = np.array([search_at[r["search_id"]] for r in rows], np.int64)
    rare = np.array([r["is_candidate"] for r in rows], bool)
    least = np.ones(len(ids), np.int64)
    if min_match:
        least[of] = [r["min_match"] for r in rows]
    docs = index.docs.select("doc_id", F.lit(-1).alias("_t"), F.col("doc_len").cast("long").alias("_v"), *filters, *([scope_key] if scope is not None and scope_key not in filters else []))
    extra, asks, inside = [], [], None
    if wanted is not None:
        of_search = {r["search_id"]: r for r in wanted.collect()}
        for k, c in enumerate(filters):
            values = sorted({r[c] for r in of_search.values()} - {None}, key=repr)
            at = {v: i for i, v in enumerate(values)}
            # -1: the search asks for nothing, -2: for no document's value, as one that isn't among the searches does
            asks.append(np.array([-1 if (v := of_search[s][c]) is None else at[v] for s in ids], np.int64))
            docs = _numbered(docs, c, values, wanted.schema[c].dataType, f"_f{k}")
            extra.append(f"_f{k}")
    if scope is not None:
        within = scope.collect()
        values = sorted({r[scope_key] for r in within} - {None}, key=repr)
        at = {v: i for i, v in enumerate(values)}
        scoped = np.zeros(len(ids), bool)
        scoped[[search_at[r["search_id"]] for r in within if r["search_id"] in search_at]] = True
        keys = np.sort(np.array([search_at[r["search_id"]] * len(values) + at[r[scope_key]] for r in within if r["search_id"] in search_at and r[scope_key] is not None], np.int64))
        inside = scoped, len(values), keys
        docs = _numbered(docs, scope_key, values, scope.schema[scope_key].dataType, "_in")
        extra.append("_in")
    docs = docs.select("doc_id", "_t", "_v", *extra)
    found = _numbered(_named(index.postings, names), "term", names, StringType(), "_t").where("_t IS NOT NULL").select("doc_id", "_t", F.col("tf").cast("long").alias("_v"), *[F.lit(None).cast("int").alias(c) for c in extra])
    kinds = {f.name: f for f in [*terms.schema.fields, *index.docs.schema.fields]}
    fields = [kinds["search_id"], kinds["doc_id"], StructField("matched", LongType()), StructField("bm25", DoubleType())]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    shared = terms.sparkSession.sparkContext.broadcast((pa.array(ids, arrow[0].type), starts, of, rare, weight, least, asks, inside, float(stats["avg_len"] or 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, starts, of, rare, weight, least, asks, inside, avg_len = shared.value
        best, floor = {}, np.full(len(names), -np.inf)
        for doc, of_doc, search, matched, score in (h for docs in whole_documents(batches, max(1, DENSE // max(1, len(names)))) for h in hits(docs, len(names), starts, of, rare, weight, least, asks, inside, avg_len)):
            if limit is None:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(search)), doc.take(pa.array(of_doc)), pa.array(matched), pa.array(score)], schema=arrow)
                continue
            good = best_of_each(search, score, np.flatnonzero(score >= floor[search]), limit)
            keys = np.empty(len(good), object)
            keys[:] = list(zip(doc.take(pa.array(of_doc[good])).to_pylist(), matched[good].tolist(), strict=True))
            seen, cuts = np.unique(search[good], return_index=True)
            for s, i, j in zip(seen.tolist(), cuts.tolist(), np.append(cuts, len(good))[1:].tolist(), strict=True):
                before = best.get(s, (np.empty(0), np.empty(0, object)))
                best[s] = first_places(np.append(before[0], score[good[i:j]]), np.append(before[1], keys[i:j]), limit)
                if len(best[s][0]) == limit:
                    floor[s] = best[s][0].min() - 2e-6  # scores are compared rounded
        for s, (score, keys) in best.items():
            doc, matched = zip(*keys.tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.full(len(keys), s))), pa.array(doc, arrow[1].type), pa.array(matched, pa.int64()), pa.array(score)], schema=arrow)

    both = found.unionByName(docs).where("doc_id IS NOT NULL")
    return both.repartition("doc_id").sortWithinPartitions("doc_id", "_t").mapInArrow(run, StructType(fields))


def best_of_each(search: np.ndarray, score: np.ndarray, among: np.ndarray, limit: int) -> np.ndarray:
    """The places, by search, of the hits among these that may be in the first `limit` of their search; scores are compared
    rounded."""
    among = among[np.lexsort((-score[among], search[among]))]
    _, cuts = np.unique(search[among], return_index=True)
    ends = np.append(cuts, len(among))[1:]
    last = score[among[np.minimum(cuts + limit, ends) - 1]]
    return among[score[among] >= np.repeat(last, ends - cuts) - 2e-6]


def whole_documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows that come by document, in tables of whole documents, `most` or fewer in each."""
    rest = None
    for b in chain(batches, [None]):
        t = rest if b is None else pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        if t is None or not len(t):
            continue
        t = t.combine_chunks()
        at = np.append(0, np.flatnonzero(pc.not_equal(t["doc_id"][1:], t["doc_id"][:-1]).to_numpy(zero_copy_only=False)) + 1)
        at = np.append(at, len(t)) if b is None else at  # the last document may go on in the next batch
        for i in range(0, len(at) - 1, most):
            end = at[min(i + most, len(at) - 1)]
            yield t.slice(at[i], end - at[i])
        rest = t.slice(at[-1])


def hits(t: pa.Table, n: int, starts: np.ndarray, of: np.ndarray, rare: np.ndarray, weight: np.ndarray, least: np.ndarray, asks: list[np.ndarray], inside: tuple | None, avg_len: float) -> Iterator[tuple]:
    """(ids, place of each hit's id, search, matched, score) of whole documents: postings (_t: the term's number, _v: how
    often) after their document's rows (_t: -1, _v: its length). starts: where each term's searches begin in of, rare, weight."""
    term, value = t["_t"].to_numpy(), t["_v"].to_numpy()
    new = np.append(True, pc.not_equal(t["doc_id"][1:], t["doc_id"][:-1]).to_numpy(zero_copy_only=False))
    group, ids = np.cumsum(new) - 1, t["doc_id"].filter(pa.array(new)).combine_chunks()
    unit = np.flatnonzero(term == -1)
    posting = np.flatnonzero(term >= 0)
    # a document is one row; where its id repeats, its postings count for each of its rows
    first = np.searchsorted(group[unit], np.arange(len(ids) + 1))
    times = np.diff(first)[group[posting]]
    posting, u = np.repeat(posting, times), spread(first[group[posting]], times)
    size = starts[term[posting] + 1] - starts[term[posting]]
    part = value[posting] * (scoring.BM25_K1 + 1) / (value[posting] + scoring.BM25_K1 * (1 - scoring.BM25_B + scoring.BM25_B * np.maximum(value[unit][u], 1) / avg_len))
    at = spread(starts[term[posting]], size)
    key, part = np.repeat(u, size) * n + of[at], np.repeat(part, size)
    matched = np.bincount(key[rare[at]], minlength=len(unit) * n)
    enough = (matched > 0) & (matched >= np.tile(least, len(unit)))
    for k, a in enumerate(asks):
        has = t[f"_f{k}"].combine_chunks().fill_null(-3).to_numpy()[unit]
        enough &= ((a == -1)[None, :] | (a[None, :] == has[:, None])).ravel()
    if inside is not None:
        scoped, values, keys = inside
        has = t["_in"].combine_chunks().fill_null(-1).to_numpy()[unit]
        among = np.isin(np.arange(n)[None, :] * values + has[:, None], keys) & (has >= 0)[:, None]
        enough &= (~scoped[None, :] | among).ravel()
    some = enough[key]
    score = np.bincount(key[some], part[some] * weight[at[some]], minlength=len(unit) * n)
    hit = np.flatnonzero(enough & (score > 0))
    doc, search, matched, score = group[unit][hit // n], hit % n, matched[hit], score[hit]
    if (np.diff(first) > 1).any():
        pair, one, back = np.unique(doc * n + search, return_index=True, return_inverse=True)
        doc, search, matched, score = pair // n, pair % n, matched[one], np.bincount(back, score, len(pair))
    if len(doc):
        yield ids, doc, search, matched, score


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each, size numbers long, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _postings(index: Index, terms: DataFrame, few: bool) -> DataFrame:
    """The postings of the terms with what terms has of them."""
    names = sorted({r["term"] for r in terms.select("term").collect()}) if few else None
    return _named(index.postings, names).join(F.broadcast(terms) if few else terms, "term")


def stored(rows: DataFrame) -> DataFrame:
    """rows, written to the shared folder and read back."""
    path = scratch(rows.sparkSession, "found")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def side(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if they are counted to be few; or else the join is by shuffle."""
    return F.broadcast(rows) if _small(rows) else rows


def _small(terms: DataFrame) -> bool:
    return terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS


def top(rows: DataFrame, score: str, limit: int, by: Sequence[str] = ("search_id",), tie: Sequence[str] = ("doc_id",), digits: int = 6) -> DataFrame:
    """The first `limit` rows of each group with their rank from 1; scores are compared rounded, so every engine agrees on ties."""
    order = Window.partitionBy(*by).orderBy(F.round(score, digits).desc(), *tie)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def boosted(hits: DataFrame, docs: DataFrame, searches: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """hits with `score`: BM25 times the lexical boosts. docs: doc_id, title, text, number, role."""
    q = searches.select("search_id", F.lower("query").alias("_query"), tokens(F.col("query"), stopwords).alias("_terms"))
    low = docs.select("doc_id", F.lower("title").alias("_title"), F.lower("text").alias("_text"), F.lower("number").alias("_number"), "role", tokens(F.col("title"), stopwords).alias("_title_terms"))
    boost = scoring.lexical_boost(F.col("_query"), F.col("_terms"), F.col("_title"), F.col("_title_terms"), F.col("_text"), F.coalesce("_number", F.lit("")), F.col("role"))
    return hits.join(side(q), "search_id").join(low, "doc_id").withColumn("score", F.col("bm25") * boost).drop("_query", "_terms", "_title", "_text", "_number", "_title_terms")


def title_search(titles: DataFrame, searches: DataFrame, stopwords: Sequence[str] = (), least: float = scoring.TITLE_MIN_SCORE, limit: int | None = None, with_runs: bool = True, key: str = "doc_id") -> DataFrame:
    """(search_id, key, title, title_score) of titles that score enough; key is unique in titles. Searches whose terms can be
    broadcast go to the titles, each of which is scored in its task; more of them meet the titles by shuffles."""
    q = searches.select("search_id", F.lower(normalize_space(F.col("query"))).alias("_q"), tokens(F.lower(normalize_space(F.col("query"))), stopwords).alias("_qt")).where(F.size("_qt") > 0)
    t = titles.select(key, "title", F.lower(normalize_space(F.col("title"))).alias("_t"), tokens(F.lower(normalize_space(F.col("title"))), stopwords).alias("_tt"))
    few = (q.agg(F.sum(F.size("_qt"))).first()[0] or 0) <= BROADCAST_TERMS
    out = _by_title(t, q, least, with_runs, key) if few else _by_title_pair(t, q, least, with_runs, key)
    return top(out, "title_score", limit, tie=(key,)) if limit else out


def _by_title(t: DataFrame, q: DataFrame, least: float, with_runs: bool, key: str) -> DataFrame:
    """The titles that score enough, title by title: a title's row alone meets all searches, so that no row is made for a
    pair that scores less and nothing is shuffled."""
    asked = q.collect()
    names = sorted({w for r in asked for w in r["_qt"]})
    number = {w: i for i, w in enumerate(names)}
    term = np.array([number[w] for r in asked for w in r["_qt"]], np.int64)
    of = np.repeat(np.arange(len(asked)), [len(r["_qt"]) for r in asked])
    lists, tables, at = [listed(term, of, len(names))], [], term
    for n in (2, 3, 4) if with_runs else ():  # runs of n are numbered by those of n - 1 and the next term
        pairs = next_runs(at, term, of, n, len(names))
        tables.append(np.unique(pairs[pairs >= 0]))
        at = places(tables[-1], pairs)
        lists.append(listed(at[at >= 0], of[: len(at)][at >= 0], len(tables[-1])))
    fields = [q.schema["search_id"], t.schema[key], t.schema["title"], StructField("title_score", DoubleType())]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    strings = [(r["_q"], " ".join(r["_qt"])) for r in asked]
    shared = q.sparkSession.sparkContext.broadcast((pa.array([r["search_id"] for r in asked], arrow[0].type), pa.array(names, pa.string()), strings, lists, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, strings, lists, tables = shared.value
        for b in batches if len(ids) else ():
            for place, search, score in title_scores(b, names, strings, lists, tables, least):
                columns = [ids.take(pa.array(search)), b.column(key).take(pa.array(place)), b.column("title").take(pa.array(place)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return t.withColumn("_nt", F.size(F.array_distinct("_tt"))).mapInArrow(run, StructType(fields))


def title_scores(b: pa.RecordBatch, names: pa.Array, strings: list[tuple[str, str]], lists: list[tuple], tables: list[np.ndarray], least: float) -> Iterator[tuple]:
    """(row, search, score) of a batch's titles (_t, their tokens _tt and number of distinct ones _nt) that score enough.
    strings: each search's, and its tokens in order; lists: the searches of each token, and of each run of two, three and
    four; tables: the runs. The score is scoring.title_score()."""
    n, words, n_title = len(strings), b.column("_tt"), b.column("_nt").to_numpy().astype(np.int64)
    n_query = np.bincount(lists[0][1], minlength=n)
    term = pc.index_in(words.flatten(), value_set=names).fill_null(-1).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(words).to_numpy())
    met = [np.divmod(np.unique((row * len(names) + term)[term >= 0]), len(names))]
    at = term
    for k, table in enumerate(tables):
        at = places(table, next_runs(at, term, row, k + 2, len(names)))
        met.append((row[: len(at)][at >= 0], at[at >= 0]))
    slashed = np.array(["/" in q for q, _ in strings])
    title_slashed = pc.match_substring(b.column("_t"), "/").to_numpy(zero_copy_only=False)
    cost = np.full(b.num_rows, float(n))
    for (r, a), (starts, _) in zip(met, lists, strict=True):
        cost += np.bincount(r, (starts[a + 1] - starts[a]), b.num_rows)
    cuts = np.append(np.flatnonzero(np.diff(np.cumsum(cost) // DENSE, prepend=-1)), b.num_rows)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):

        def pairs(k: int, low: int = low, high: int = high) -> np.ndarray:
            (r, a), (starts, of) = met[k], lists[k]
            i, j = np.searchsorted(r, (low, high))
            size = starts[a[i:j] + 1] - starts[a[i:j]]
            return np.repeat(r[i:j] - low, size) * n + of[spread(starts[a[i:j]], size)]

        count = np.bincount(pairs(0), minlength=(high - low) * n)
        length = np.zeros(len(count))
        for k, size in ((2, 3), (3, 4)) if tables else ():
            length[pairs(k)] = size
        some = np.flatnonzero(count)
        place, search, count, length = low + some // n, some % n, count[some], length[some]
        nq, nt = n_query[search], n_title[place]
        bonus = np.zeros(len(some))
        within = slashed[search] | title_slashed[place] | (count >= nq - 2) | (count >= nt - 2)  # scoring.may_contain()
        for i in np.flatnonzero(within).tolist():
            (q, q_terms), title = strings[search[i]], b.column("_t")[place[i]].as_py()
            bonus[i] = 80.0 if q == title else 45.0 if q in title or title in q else 35.0 if count[i] == nq[i] else 0.0
            bonus[i] += 35.0 if q_terms in " ".join(words[place[i]].as_py()) else 0.0
        score = count / nq * 60.0 + count / nt * 35.0 + count * 4.0 + bonus + length * 12.0
        score *= np.where((nt <= 2) & (nq >= 4) & (count / nq < 0.75), 0.55, 1.0)
        good = score >= least
        yield place[good], search[good], score[good]


def next_runs(runs_before: np.ndarray, term: np.ndarray, of: np.ndarray, n: int, terms: int) -> np.ndarray:
    """For each run of n terms of one row the number of its first n - 1 and its last as one number; -1 where one is none."""
    m = max(0, len(term) - n + 1)
    return np.where((runs_before[:m] >= 0) & (term[n - 1 :] >= 0) & (of[:m] == of[n - 1 :]), runs_before[:m] * terms + term[n - 1 :], -1)


def places(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    at = np.searchsorted(table, values)
    return np.where(np.append(table, -2)[at] == values, at, -1)


def listed(numbers: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each number's owners begin, and the owners, each once."""
    number, owner = np.unique(np.stack([numbers, of]), axis=1)
    return np.searchsorted(number, np.arange(n + 1)), owner


def _by_title_pair(t: DataFrame, q: DataFrame, least: float, with_runs: bool, key: str) -> DataFrame:
    """The titles that score enough, by joins.

    A pair that scores enough shares a run of three tokens, or so many tokens (fewest_shared) that it shares one even of the
    title's least asked ones, all but that many less one. So titles meet searches by their runs and by those tokens, not by
    the words that nearly every search has. The pairs found are counted exactly, which makes the score, but for what only
    the strings can tell of the few of which one may contain the other."""
    slash, pair = F.lit("/"), ["search_id", key]
    asked = q.select("search_id", F.array_distinct("_qt").alias("_qd"), F.contains("_q", slash).alias("_sq")).withColumn("_nq", F.size("_qd"))
    named = t.select(key, F.array_distinct("_tt").alias("_td"), F.contains("_t", slash).alias("_st")).withColumn("_nt", F.size("_td"))
    by_token = asked.select("search_id", "_nq", "_sq", F.explode("_qd").alias("_token"))
    often = by_token.groupBy("_token").agg(F.count(F.lit(1)).alias("_often"))
    # tokens that no search has come first in a title's order, so only their number matters
    tokens_of = named.select(key, "_nt", "_st", F.explode("_td").alias("_token")).join(side(often), "_token")
    place = F.row_number().over(Window.partitionBy(key).orderBy("_often", "_token"))
    tokens_of = tokens_of.withColumn("_place", place + F.col("_nt") - F.count(F.lit(1)).over(Window.partitionBy(key)))
    few = fewest_shared(F.col("_nq"), F.col("_nt"), F.col("_sq") | F.col("_st"), least) if with_runs else F.lit(1)
    found = tokens_of.join(side(by_token), "_token").where(F.col("_place") <= F.col("_nt") - few + 1).select(*pair, F.lit(None).cast("int").alias("_run"))
    if with_runs:
        runs_of = [_hashed_runs(t, key, "_tt"), _hashed_runs(q, "search_id", "_qt")]
        found = found.unionByName(runs_of[0].join(side(runs_of[1]), ["_run", "_h"]).select(*pair, "_run"))
    found = found.groupBy(*pair).agg(F.max("_run").alias("_run"))
    met = found.join(side(asked), "search_id").join(named, key).select(*pair, "_run", "_nq", "_nt", "_sq", "_st", F.size(F.array_intersect("_qd", "_td")).alias("_n"))
    counts = [F.col(c) for c in ("_n", "_nq", "_nt")]
    base = met.withColumn("_plain", scoring.title_score_of(*counts, F.lit(0.0), F.col("_run"))).withColumn("_within", scoring.may_contain(*counts, F.col("_sq") | F.col("_st")))
    plain = base.where(~F.col("_within") & (F.col("_plain") >= least)).select(*pair, F.col("_plain").alias("title_score")).join(t.select(key, "title"), key)
    read = base.where("_within").join(t, key).join(side(q), "search_id")
    bonus = scoring.title_bonus(F.col("_q"), F.col("_qt"), F.col("_t"), F.col("_tt"), F.col("_n") == F.col("_nq"))
    close = read.withColumn("title_score", scoring.title_score_of(*counts, bonus, F.col("_run"))).where(F.col("title_score") >= least)
    scored = plain.select(*pair, "title", "title_score").unionByName(close.select(*pair, "title", "title_score"))
    return scored.select("search_id", key, "title", "title_score")


def fewest_shared(query_size: Column, title_size: Column, slashes: Column, least: float) -> Column:
    """The least number of shared tokens with which a pair without a shared run of three can score `least`. Where one string
    may contain the other without such a run (under five tokens, or slashes that join tokens), one."""
    score = F.lit(60.0) / query_size + F.lit(35.0) / title_size + 4.0
    enough = F.least(query_size, F.ceil(F.lit(least) / score - 1e-9).cast("int"))
    return F.when(slashes | (query_size < 5) | (title_size < 5), 1).otherwise(F.greatest(enough, F.lit(1)))


def _hashed_runs(rows: DataFrame, key: str, terms: str, sizes: Sequence[int] = (3, 4)) -> DataFrame:
    """(key, _run, _h): the hash of each run of so many tokens."""

    def of(n: int) -> Column:
        return F.transform(F.array_distinct(runs(F.col(terms), n)), lambda r: F.struct(F.lit(n).alias("_run"), F.xxhash64(r).alias("_h")))

    return rows.select(key, F.explode(F.concat(*map(of, sizes))).alias("_r")).select(key, "_r.*")


def dedupe_ranked(rows: DataFrame, keys: Sequence[Column], order: Sequence[Column], by: Sequence[str] = ("search_id",)) -> DataFrame:
    """First row in rank order of each key within a search."""
    named = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    w = Window.partitionBy(*by, *[f"_k{i}" for i in range(len(keys))]).orderBy(*order)
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(keys))])


def quota_top(rows: DataFrame, group: str, limit: int, order: Sequence[Column], by: Sequence[str] = ("search_id",), groups: int = 2) -> DataFrame:
    """`limit` rows a search: each group's share first, then the best of the rest."""
    share = max(1, limit // max(1, groups))
    own = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    first = rows.withColumn("_late", (own > share).cast("int"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_late", *order))
    return first.withColumn("_place", place).where(F.col("_place") <= limit).drop("_late", "_place")


def near_best(rows: DataFrame, score: str, ratio: float = 0.75, by: Sequence[str] = ("search_id",)) -> DataFrame:
    """Rows of at least `ratio` times their group's best score; rows are made once."""
    best = F.max(score).over(Window.partitionBy(*by))
    return rows.dropna(subset=list(by)).withColumn("_best", best).where(F.col(score) >= ratio * F.col("_best")).drop("_best")


def vector_top(vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Dot products of every vector with each query vector (query_id, query_vector): a stated set of queries, checked to
    be small and broadcast; `limit` best of each, ties by key. Vectors of one length are multiplied as matrices, and a task
    hands on its best alone; rows with nulls, other lengths or numbers that aren't moderate are multiplied one by one."""
    if not _small(queries):
        raise ValueError("too many query vectors for one pass; give them in blocks")
    dimension = queries.agg(F.max(F.size("query_vector"))).first()[0] or 0
    plain, asked_plain = moderate(vector, dimension), moderate("query_vector", dimension)
    said, rest = [c for c in queries.columns if c != "query_vector"], [key, *(c for c in vectors.columns if c not in (key, vector))]
    asked = queries.where(asked_plain).select(*said, F.col("query_vector").cast("array<double>").alias("query_vector")).collect()
    ids, matrix = [tuple(r[c] for c in said) for r in asked], np.array([r["query_vector"] for r in asked]).reshape(len(asked), -1)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    fields = [*(queries.schema[c] for c in said), *(vectors.schema[c] for c in rest), StructField("score", DoubleType())]
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        best = [(np.empty(0), np.empty(0, object)) for _ in ids]
        floor = np.full(len(ids), -np.inf)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            x, held = b.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), np.empty(b.num_rows, object)
            held[:] = list(zip(*[b.column(c).to_pylist() for c in rest], strict=True))
            for at in range(0, len(ids), PRODUCTS):
                scores = matrix[at : at + PRODUCTS] @ x.T
                of, row = np.nonzero(scores >= floor[at : at + PRODUCTS, None])
                cuts = np.searchsorted(of, np.arange(len(scores) + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    here = row[cuts[k] : cuts[k + 1]]
                    best[at + k] = first_places(np.append(best[at + k][0], scores[k, here]), np.append(best[at + k][1], held[here]), limit)
                    if len(best[at + k][0]) == limit:
                        floor[at + k] = best[at + k][0].min() - 2e-6  # scores are compared rounded
        for said_, (score, found) in zip(ids, best, strict=True):
            if len(score):
                columns = list(zip(*[(*said_, *f, s) for f, s in zip(found.tolist(), score.tolist(), strict=True)], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    flat = vectors.where(plain).select(*rest, F.col(vector).cast("array<double>").alias(vector))
    near = flat.mapInArrow(multiply, StructType(fields))
    dot = F.aggregate(F.zip_with(vector, "query_vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    odd = vectors.where(~plain).crossJoin(F.broadcast(queries)).unionByName(vectors.where(plain).crossJoin(F.broadcast(queries.where(~asked_plain))))
    scored = near.unionByName(odd.withColumn("score", dot).select(*near.columns)).select(*rest, *said, "score")
    return top(scored, "score", limit, by=("query_id",), tie=(key,))


def moderate(vector: str, dimension: int) -> Column:
    """Vectors of this length whose numbers are there and far from overflow in a product."""
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < 1e140))
    return F.coalesce((F.size(vector) == dimension) & (F.size(vector) > 0) & fine, F.lit(False))


def first_places(score: np.ndarray, keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `limit` by score rounded to six digits, half away from zero as Spark rounds it, ties by the first of keys'
    tuples."""
    if len(score) <= limit:
        return score, keys
    near = score >= np.partition(score, -limit)[-limit] - 2e-6
    score, keys = score[near], keys[near]
    scaled = np.abs(score) * 1e6
    whole = np.floor(scaled + 0.5)
    close = np.abs(scaled + 0.5 - np.round(scaled + 0.5)) < 1e-6 + scaled * 1e-12
    for i in np.flatnonzero(close).tolist():
        whole[i] = float(Decimal(repr(float(abs(score[i])))).quantize(Decimal("0.000001"), ROUND_HALF_UP).scaleb(6))
    rounded = np.where(score < 0, -whole, whole).tolist()
    order = sorted(range(len(score)), key=lambda i: (-rounded[i], keys[i][0] is not None, keys[i][0]))[:limit]
    return score[order], keys[order]
