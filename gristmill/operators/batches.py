"""Batches for contrastive training: rows of one law together, the rest filled from all, and no text twice in a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.order import ordinal, running_sum, settle


#: Seats of others that a row without one is offered in a round.
TRIES = 8


def _priority(seed: str, *parts: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]))


def batch_quotas(questions: DataFrame, batches: int, law: str = "law", seed: str = "0:0") -> DataFrame:
    """law, n, quota: how many of so many batches each law gets, in proportion to its rows n.

    The laws stand in hash order, each as wide as its rows, and batches stand on them at even distances. So a quota is the
    law's share rounded down or up, and together they are all the batches. Nulls are a law of their own.
    """
    laws = questions.groupBy(F.col(law).alias("law")).agg(F.count(F.lit(1)).alias("n"))
    laws = running_sum(laws.withColumn("_order", _priority(seed, "law")), F.col("n"), "_order", "law", name="_before")
    total = F.lit(questions.count()).cast("decimal(20,0)")
    # Half the rows ahead: the first batch doesn't stand on the first law's edge.
    upto = lambda rows: F.call_function("div", rows.cast("decimal(20,0)") * F.lit(batches).cast("decimal(18,0)") + F.call_function("div", total, F.lit(2)), total)
    return laws.select("law", "n", (upto(F.col("_before") + F.col("n")) - upto(F.col("_before"))).cast("long").alias("quota"))


def _free_of_repeats(seated: list[DataFrame], candidates: DataFrame) -> DataFrame:
    """Candidates (_texts, batch_no, _seat, which tells them apart) no text of which is in their batch: not seated there, nor of an earlier candidate.

    A batch holds few rows, so groups by batch and text stay small however common a text is.
    """
    texts = candidates.select("batch_no", "_seat", F.explode("_texts").alias("_text"))
    firsts = texts.groupBy("batch_no", "_text").agg(F.min("_seat").alias("_first"))
    clash = texts.join(firsts, ["batch_no", "_text"]).filter("_seat > _first").select("_seat")
    if seated:
        there = reduce(DataFrame.union, seated).select("batch_no", F.explode("_texts").alias("_text"))
        clash = clash.union(texts.join(there, ["batch_no", "_text"], "left_semi").select("_seat"))
    return candidates.join(clash.distinct(), "_seat", "left_anti")


def law_batches(questions: DataFrame, batch: int, ratio: float, texts: list[str], id_col: str = "qid", law_col: str = "law", seed: int = 0, epoch: int = 0, drop_last: bool = False, patience: int = 3) -> DataFrame:
    """qid, law, batch_no, part: as many batches as rows fill, of ``batch`` rows, of which round(batch * ratio) are of one law.

    A law gets batches in proportion to its rows (``batch_quotas``). Its rows, in hash order, take the seats of their law (part same) in its
    batches one after the other; what is left over is dealt, in hash order again, to the open seats in the order of batches
    (part fill). Whoever finds one of his ``texts`` in the batch gives the seat up and is dealt anew in the next round, in which
    only such rows and open seats move; if nobody fits an open seat, some take the seats of filled-in rows elsewhere, which are dealt next. Rounds
    end when all rows sit, or when ``patience`` of them in turn leave no fewer: rows whose texts fit nowhere are left out, and
    their batches are shorter. ``drop_last`` leaves out short batches.
    With ratio 0 all rows are dealt, whatever their law.

    Rows are numbered by ranges of a total order, so a law or a text that many rows have is spread over tasks. Texts are told apart
    by their MD5. Null texts repeat nothing; null laws are a law; repeated rows are rows like others. ``seed`` and ``epoch``
    give the order: the same ones give the same batches, rows that are equal in id and texts apart.
    """
    if not 0 <= ratio <= 1:
        raise ValueError(f"ratio must be from 0 to 1: {ratio}")
    digests = F.array_distinct(F.filter(F.array(*[F.md5(F.col(c).cast("string")) for c in texts]), lambda x: x.isNotNull()))
    key = f"{seed}:{epoch}"
    rows = questions.select(F.col(id_col).alias("qid"), F.col(law_col).alias("law"), digests.alias("_texts"))
    rows = rows.withColumn("_order", _priority(key, "qid"))
    rows = ordinal(rows, "law", "_order", "qid", F.array_join("_texts", ""), name="_row").drop("_order")
    total = rows.count()
    many = total // batch if drop_last else -(-total // batch)
    schema = rows.select("qid", "law", F.lit(0).cast("long").alias("batch_no"), F.lit("").alias("part"))
    if not many:
        return schema.limit(0)
    own, fills = rows.limit(0).withColumns({"batch_no": F.lit(0).cast("long"), "part": F.lit("same")}), []
    waiting = settle(rows)
    if ratio:
        same = max(1, round(batch * ratio))
        quotas = batch_quotas(rows, many, seed=key)
        numbered = quotas.filter("quota > 0").select("law", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("_i"))
        numbered = ordinal(numbered.withColumn("_order", _priority(key, "law", "_i")), "_order", "law", "_i", name="batch_no").select(F.col("law").alias("_law"), "_i", "batch_no")
        firsts = rows.groupBy(F.col("law").alias("_law")).agg(F.min("_row").alias("_first"))
        placed = rows.join(firsts, F.col("law").eqNullSafe(F.col("_law"))).drop("_law").withColumn("_at", F.col("_row") - F.col("_first")).drop("_first")
        mine = F.col("law").eqNullSafe(F.col("_law")) & (F.floor(F.col("_at") / same) == F.col("_i"))
        wish = placed.join(numbered, mine).select("qid", "law", "_texts", "_row", "batch_no", F.col("_row").alias("_seat"))
        own = settle(_free_of_repeats([], wish).select("qid", "law", "_texts", "_row", "batch_no", F.lit("same").alias("part")))
        waiting = settle(rows.join(own, "_row", "left_anti"))
    every = questions.sparkSession.range(many).withColumnRenamed("id", "batch_no")
    least, stale, turn = total + 1, 0, 0
    while (left := waiting.count()) and stale < patience:
        least, stale, turn = min(least, left), 0 if left < least else stale + 1, turn + 1
        seated = [own, *fills]
        queue = ordinal(waiting.withColumn("_order", _priority(f"{key}:{turn}", "qid", "_row")), "_order", "_row", name="_seat").drop("_order")
        taken = reduce(DataFrame.union, seated).groupBy("batch_no").agg(F.count(F.lit(1)).alias("_many"))
        room = every.join(taken, "batch_no", "left").select("batch_no", (F.lit(batch) - F.coalesce("_many", F.lit(0))).cast("long").alias("_open")).filter("_open > 0")
        seats = running_sum(room, F.col("_open"), "batch_no", name="_before")
        seats = seats.select("batch_no", F.explode(F.sequence(F.col("_before"), F.col("_before") + F.col("_open") - 1)).alias("_seat"))
        won = settle(_free_of_repeats(seated, queue.join(seats, "_seat")).select("qid", "law", "_texts", "_row", "batch_no", F.lit("fill").alias("part")))
        if won.isEmpty() and fills:
            # Nobody fits the open seats: some rows take the seats of others in batches that they do fit, and those are dealt next.
            rest = reduce(DataFrame.union, fills)
            offers = ordinal(rest.withColumn("_order", _priority(f"{key}:{turn}:out", "qid", "_row")), "_order", "_row", name="_seat").filter(F.col("_seat") < TRIES * left)
            offers = offers.select((F.col("_seat") % left).alias("_for"), F.col("_seat").alias("_offer"), "batch_no", F.col("_row").alias("_out"))
            offers = queue.withColumnRenamed("_seat", "_for").join(offers, "_for").withColumnRenamed("_offer", "_seat")
            first = Window.partitionBy("_row").orderBy("_seat")
            won = _free_of_repeats(seated, offers).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
            won = settle(won.select("qid", "law", "_texts", "_row", "batch_no", F.lit("fill").alias("part"), "_out"))
            out = rest.join(won.select(F.col("_out").alias("_row")), "_row", "left_semi")
            waiting = settle(waiting.join(won, "_row", "left_anti").select(rows.columns).union(out.select(rows.columns)))
            fills = [settle(rest.join(won.select(F.col("_out").alias("_row")), "_row", "left_anti").select(own.columns).union(won.select(own.columns)))]
        else:
            fills.append(won.select(own.columns))
            waiting = settle(waiting.join(won, "_row", "left_anti").select(rows.columns))
    out = reduce(DataFrame.union, [x.select("qid", "law", "batch_no", "part") for x in (own, *fills)])
    if drop_last:
        whole = out.groupBy("batch_no").agg(F.count(F.lit(1)).alias("_many")).filter(F.col("_many") == batch).select("batch_no")
        out = out.join(whole, "batch_no", "left_semi").select("qid", "law", "batch_no", "part")
    return out


def batch_statistics(batches: DataFrame) -> DataFrame:
    """batches, rows, mean_top_law_rows: how many rows batches have of their commonest law, on average."""
    laws = batches.groupBy("batch_no", "law").agg(F.count(F.lit(1)).alias("_n"))
    tops = laws.groupBy("batch_no").agg(F.max("_n").alias("_top"), F.sum("_n").alias("_rows"))
    return tops.agg(F.count(F.lit(1)).alias("batches"), F.sum("_rows").alias("rows"), F.avg("_top").alias("mean_top_law_rows"))
