"""Store documents and retrieval: text summaries, exact nearest neighbours, forced context."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import entity_id
from quillmill.operators.features import MONTHS
from quillmill.sources.staging import staged

#: Pivots at most, whose vectors go to every task, and items and queries that meet in one task.
PIVOTS, CROWD, ASKED = 1000, 20_000, 4000
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
#: Label and form of the sentences on means.
MEANS = {
    "temperature_avg": ("Avg temperature", "%.1f"), "precipitation_mm": ("Avg precipitation mm", "%.1f"), "gdp_index": ("GDP index", "%.2f"),
    "unemployment_rate": ("Unemployment rate", "%.2f"), "trend_index": ("Google Trend index", "%.2f"),
}


def whole(c: Column) -> Column:
    return F.bround(F.round(c, 6), 0).cast("bigint").cast("string")  # sums in another order must not tip a half


def figure(c: Column, form: str) -> Column:
    """A mean to the digits of ``form``, a half away from zero, after the digits that depend on the order of its sum are rounded away."""
    return F.when(c.isNotNull(), F.format_string(form, F.round(F.round(c, 6), int(form[2])) + 0.0))  # never -0


def store_documents(df: DataFrame, title: str = "Store ID") -> DataFrame:
    """One document per store from its training rows, sales figures from its open days.

    A sentence without value is left out, as are those on promotions, weather, economy and events for which ``df`` has no column.
    """
    also = [c for c in (*MEANS, "has_promo2", "has_local_event", "promo") if c in df.columns]
    weather = [F.mode("weather_event", True).alias("weather_event")] if "weather_event" in df.columns else []
    train = df.where("is_train = 1").withColumns({"__dow": F.weekday("date"), "__month": F.month("date")})
    open_sales = F.when(F.col("is_open") == 1, F.col("sales"))
    modes = {"Store Type": "description_type", "Assortment": "description_assortment", "State": "state"}
    own = train.groupBy("store_id").agg(
        *(F.mode(c, True).alias(c) for c in modes.values()), F.median("distance_meters").alias("distance"), F.mode("open_since_year", True).alias("since"),
        F.avg(open_sales).alias("sales"), *(F.avg(c).alias(c) for c in also), *weather, *(F.avg(open_sales_on).alias(f"d{i}") for i, open_sales_on in enumerate(F.when(F.col("__dow") == i, open_sales) for i in range(7))),
        *(F.avg(F.when(F.col("__month") == i, open_sales)).alias(f"m{i}") for i in range(1, 13)),
    )
    days = F.array(*(F.when(F.col(f"d{i}").isNotNull(), F.struct(F.lit(d).alias("name"), F.bround(F.round(f"d{i}", 6), 0).alias("v"))) for i, d in enumerate(DAYS)))
    days = F.filter(days, lambda x: x.isNotNull())
    low = F.aggregate(days, F.get(days, F.lit(0)), lambda a, x: F.when(x["v"] < a["v"], x).otherwise(a))
    high = F.aggregate(days, F.get(days, F.lit(0)), lambda a, x: F.when(x["v"] > a["v"], x).otherwise(a))
    part = lambda x: F.concat(x["name"], F.lit(": "), whole(x["v"]))
    months = F.concat_ws(", ", *(F.concat(F.lit(f"{m}: "), whole(F.col(f"m{i}"))) for i, m in enumerate(MONTHS, 1)))
    sentences = [
        F.concat(F.lit(f"{title} "), F.col("store_id").cast("string"), F.lit(".")),
        *(F.concat(F.lit(f"{k}: "), F.col(c), F.lit(".")) for k, c in modes.items()),
        F.concat(F.lit("Competitor distance: "), whole(F.col("distance")), F.lit(" meters.")),
        F.concat(F.lit("Open since: "), F.col("since").cast("bigint").cast("string"), F.lit(".")),
        F.concat(F.lit("Average daily sales (open days): "), whole(F.col("sales")), F.lit(".")),
        F.when(F.size(days) > 0, F.concat(F.lit("Average sales by day of week — "), F.array_join(F.transform(days, part), ", "), F.lit("."))),
        F.concat(F.lit("Lowest sales day: "), low["name"], F.lit(" ("), whole(low["v"]), F.lit("). Highest: "), high["name"], F.lit(" ("), whole(high["v"]), F.lit(").")),
        F.when(months != "", F.concat(F.lit("Average sales by month — "), months, F.lit("."))),
    ]
    more = {
        "promo": lambda c: F.concat(F.lit("Promotion active "), whole(c * 100), F.lit("% of days.")),
        "has_promo2": lambda c: F.concat(F.lit("Has Promo2 scheme: "), F.when(c > 0.5, "yes").when(c <= 0.5, "no"), F.lit(".")),
        **{c: (lambda x, label=label, f=f: F.concat(F.lit(f"{label}: "), figure(x, f), F.lit("."))) for c, (label, f) in list(MEANS.items())[:2]},
        "weather_event": lambda c: F.concat(F.lit("Most common weather: "), c, F.lit(".")),
        **{c: (lambda x, label=label, f=f: F.concat(F.lit(f"{label}: "), figure(x, f), F.lit("."))) for c, (label, f) in list(MEANS.items())[2:]},
        "has_local_event": lambda c: F.concat(F.lit("Local events on "), whole(c * 100), F.lit("% of days.")),
    }
    sentences += [sentence(F.col(c)) for c, sentence in more.items() if c in own.columns]
    return own.select("store_id", F.concat_ws(" ", *sentences).alias("content"))


def nearest(items: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", vector: str = "embedding", pivots: int | None = None, digits: int | None = None) -> DataFrame:
    """Exact k nearest by L2 distance, ties to the smaller id -> query_id, id, distance, rank.

    Every item belongs to its nearest pivot. A query looks into its nearest pivots' items first, until these are k; the
    k-th distance there is a bound for all. Of the other items only those can be nearer whose distance to their pivot differs from
    the query's by less than the bound (triangle inequality) and whose pivot is not farther off than the query's by
    twice the bound. Items and queries meet in a shuffle by groups of pivots, large groups in several parts, and a task returns a
    query's k nearest of its part. With ``digits``, distances that are equal when so rounded are ties. Vectors that are null or hold
    what is no finite number take no part; all others are of one length.
    """
    return top_k(pairs(items, queries, k, id, vector, pivots, k, digits), k)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors of one length, a row each."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return one.flatten().to_numpy(zero_copy_only=False).reshape(len(one), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` and ``b``, but for the last digits."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows, summed from the first place to the last, as an engine of rows does."""
    parts = [np.cumsum((a[i : i + 20_000] - b[i : i + 20_000]) ** 2, axis=1)[:, -1] for i in range(0, len(a), 20_000)]
    return np.sqrt(np.concatenate(parts)) if parts else np.zeros(0)


def pivot_groups(sizes: list[int], centres: np.ndarray) -> list[int]:
    """A group for each pivot: neighbours along the line of greatest spread, together some thirtieth of the items, ``CROWD`` at most."""
    limit, spread = min(CROWD, -(-sum(sizes) // 32)), centres - centres.mean(0)
    along = spread @ spread[np.argmax((spread * spread).sum(1))]
    group, held, out = 0, 0, [0] * len(sizes)
    for p in np.argsort(along, kind="stable"):
        if held and held + sizes[p] > limit:
            group, held = group + 1, 0
        out[p], held = group, held + sizes[p]
    return out


def pairs(items: DataFrame, queries: DataFrame, k: int = 5, id: str = "id", vector: str = "embedding", pivots: int | None = None, keep: int | None = None, digits: int | None = None) -> DataFrame:
    """-> query_id, id, distance: the pairs that ``nearest`` has to look at, the k nearest of each query among them; with ``keep``,
    the ``keep`` nearest of a query in each part that it visits."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = lambda df: df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    spark, given, kind, asks = items.sparkSession, staged(vectors(items), "vectors"), dict(items.dtypes)[id], dict(queries.dtypes)[id]
    empty = f"query_id {asks}, id {kind}, distance double"
    n = given.count()
    if not n:
        return spark.createDataFrame([], empty)
    m = min(pivots or max(1, round(2 * n**0.5)), PIVOTS)
    centres = np.array([r[0] for r in given.orderBy(F.xxhash64("id"), "id").limit(m).select("v").collect()], dtype=float)  # ``PIVOTS`` at most

    def assign(batches):
        for b in batches:
            if b.num_rows:
                v = matrix(b.column("v"))
                p = np.concatenate([squares(v[i : i + 2000], centres).argmin(1) for i in range(0, len(v), 2000)])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(p.astype(np.int32)), pa.array(l2(v, centres[p]))], ["id", "v", "p", "dp"])

    own = staged(given.mapInArrow(assign, f"id {kind}, v array<double>, p int, dp double"), "assigned")
    size, lo, hi = [0] * len(centres), np.zeros(len(centres)), np.zeros(len(centres))
    for r in own.groupBy("p").agg(F.count("*").alias("n"), F.min("dp").alias("lo"), F.max("dp").alias("hi")).collect():  # as many as pivots at most
        size[r["p"]], lo[r["p"]], hi[r["p"]] = r["n"], r["lo"], r["hi"]
    group = np.array(pivot_groups(size, centres))
    held = [int(sum(s for s, g in zip(size, group) if g == i)) for i in range(group.max() + 1)]

    def tolerance(v: np.ndarray) -> float:
        """What rounding may add to a distance found by ``squares``."""
        return 1e-6 * float((v * v).sum(1).max() + (centres * centres).sum(1).max()) ** 0.5

    def survives(dq, near, t, which=slice(None)):
        t = t[:, None]
        return (dq - hi[which] <= t) & (lo[which] - dq <= t) & (dq - near[:, None] <= 2 * t)

    def ask(batches):
        """The groups in which a query starts, or, once it has a bound, those in which it goes on."""
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                q = matrix(part.column("q"))
                dq = np.sqrt(squares(q, centres))
                near = dq.min(1)
                if "bound" in b.schema.names:
                    first, bound = part.column("first").to_pylist(), part.column("bound").to_numpy()
                    going = survives(dq, near, bound + tolerance(q))
                    for j, f in enumerate(first):
                        going[j, f] = False
                    wanted = [np.flatnonzero(x) for x in going]
                else:
                    order = np.argsort(dq, axis=1, kind="stable")
                    upto = np.cumsum(np.array(size)[order], axis=1)
                    first = [o[: np.searchsorted(u, k) + 1].tolist() for o, u in zip(order, upto)]
                    wanted, bound = [np.array(f) for f in first], np.full(len(q), np.nan)
                groups = [np.unique(group[w]) if len(w) else w.astype(int) for w in wanted]
                row = np.repeat(np.arange(len(q)), [len(g) for g in groups])
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id").take(pa.array(row)), part.column("q").take(pa.array(row)), pa.array(near[row]), pa.array(bound[row]), pa.array([first[r] for r in row], pa.list_(pa.int32())), pa.array(np.concatenate(groups).astype(np.int32))],
                    ["query_id", "q", "near", "bound", "first", "g"],
                )

    def visit(these: pa.Table, those: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if these.num_rows and those.num_rows:
            ids, v, dp = these.column("id").to_numpy(), matrix(these.column("v")), these.column("dp").to_numpy()
            here, of = np.unique(these.column("p").to_numpy(), return_inverse=True)
            names, every = those.column("query_id").to_numpy(), matrix(those.column("q"))
            near, bound, first = those.column("near").to_numpy(), those.column("bound").to_numpy(), those.column("first").to_pylist()
            extra = max(tolerance(v), tolerance(every))
            for i in range(0, len(every), 200):
                q, t = every[i : i + 200], bound[i : i + 200] + extra
                begun = np.array([np.isin(here, f) for f in first[i : i + 200]])
                if np.isnan(t).all():
                    looked = begun[:, of]
                else:
                    dq = np.sqrt(squares(q, centres[here]))
                    looked = (survives(dq, near[i : i + 200], t, here) & ~begun)[:, of] & (np.abs(dq[:, of] - dp) <= t[:, None])
                if keep:
                    d2 = np.where(looked, squares(q, v), np.inf)
                    if d2.shape[1] > keep:
                        kth = np.partition(d2, keep - 1, axis=1)[:, keep - 1]
                        looked &= d2 <= ((np.sqrt(kth) + (2 * 10.0**-digits if digits else 0)) ** 2 + extra**2)[:, None]
                a, b = np.nonzero(looked)
                d = l2(q[a], v[b])
                d = np.round(d, digits) if digits else d
                if keep and len(a):
                    order = np.lexsort((ids[b], d, a))
                    a, b, d = a[order], b[order], d[order]
                    place = np.arange(len(a)) - np.searchsorted(a, a)
                    a, b, d = (x[place < keep] for x in (a, b, d))
                found.append((names[i : i + 200][a], ids[b], d))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [[], [], []]
        types = (those.schema.field("query_id").type, these.schema.field("id").type, pa.float64())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query_id", "id", "distance"), columns, types)})

    def met(asked: DataFrame) -> DataFrame:
        counts = {r["g"]: r["count"] for r in asked.groupBy("g").count().collect()}  # as many as pivots at most
        plan = [(p, int(g), -(-held[g] // CROWD), -(-counts[g] // ASKED)) for p, g in enumerate(group) if g in counts and size[p]]
        if not plan:
            return spark.createDataFrame([], empty)
        plan = spark.createDataFrame(plan, "p int, g int, parts int, chunks int")
        deal = own.join(F.broadcast(plan), "p").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        spread = asked.join(F.broadcast(plan.drop("p").distinct()), "g").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        block = ["g", "part", "chunk"]
        left, right = deal.select(*block, "id", "v", "p", "dp"), spread.select(*block, "query_id", "q", "near", "bound", "first")
        return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(visit, empty)

    shape = f"query_id {asks}, q array<double>, near double, bound double, first array<int>, g int"
    given_queries = vectors(queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    begin = staged(given_queries.mapInArrow(ask, shape), "first-pivots")
    start = staged(met(begin), "first-pairs")
    bound = top_k(start, k).groupBy("query_id").agg((F.max("distance") * (1 + 1e-9) + 1e-9).alias("bound"))  # what rounding may add
    known = begin.groupBy("query_id").agg(F.first("q").alias("q"), F.first("first").alias("first")).join(bound.hint("shuffle_hash"), "query_id")
    return start.unionByName(met(staged(known.mapInArrow(ask, shape), "query-groups")))


def forced_context(hits: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """Hits (query_id, id, rank) with the store named in the question in front, if it is none of them; k in all."""
    named = questions.select("query_id", entity_id(F.col("question")).alias("id")).where("id IS NOT NULL")
    lacking = named.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("rank", F.lit(0))
    both = hits.select("query_id", "id", "rank").unionByName(lacking)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return both.withColumn("rank", place).where(F.col("rank") <= k)


def context(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of the hits joined by blank lines in the order of rank -> query_id, context."""
    texts = hits.join(documents.select(F.col("store_id").alias("id"), "content"), "id")
    got = texts.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("x"))
    return got.select("query_id", F.array_join(F.transform("x", lambda t: t["content"]), "\n\n").alias("context"))
