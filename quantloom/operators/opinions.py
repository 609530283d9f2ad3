"""What models and experts say of single securities: votes with their texts, best opinions, risks, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that turn a text to its risks, in its own model's text and in others', and where such a clause ends.
OWN_TURNS = ("但", "虽", "不过", "需注意", "警惕")
OTHER_TURNS = ("但", "虽", "不过", "风险", "空方")
CLAUSE, SHORTEST_RISK, RISKS = "^[^。；]*", 5, 3


def first_known(column: str, *order: str) -> Column:
    """The first value of a group that is neither null nor empty; '' without any."""
    known = F.when(F.col(column) != "", F.col(column))
    return F.coalesce(F.min_by(known, F.when(known.isNotNull(), F.struct(*order))), F.lit(""))


def panel_picks(picks: DataFrame) -> DataFrame:
    """(code, name, sector, votes, mean_score, mean_stars, consensus) of picks(model, pos, code, name, sector, score, stars).

    Codes are trimmed, empty ones don't count; score null is 70, stars null 3; means at 1 place.  name and sector are the
    first that are not empty, by pos; consensus is the mean score and 5 for each further vote.
    """
    x = picks.withColumn("code", F.trim("code")).where("code <> ''")
    mean = lambda c, d: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(float(d)))), 1)
    g = x.groupBy("code").agg(first_known("name", "pos").alias("name"), first_known("sector", "pos").alias("sector"), F.count("*").alias("votes"), mean("score", 70).alias("mean_score"), mean("stars", 3).alias("mean_stars"))
    return g.withColumn("consensus", F.col("mean_score") + 5 * (F.col("votes") - 1))


def breakout_votes(picks: DataFrame, most: int = 15) -> DataFrame:
    """(place, code, votes, score, name, reasoning) of picks(pos, code, score, name, reasoning): by votes, then best score.

    score null is 0; name and reasoning are of the pick with the best score, the first of equals.  Order: votes and score
    descending, then the code named first.
    """
    x = picks.where("code <> ''").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    best = F.max_by(F.struct("name", "reasoning"), F.struct("score", -F.col("pos")))
    g = x.groupBy("code").agg(F.count("*").alias("votes"), F.max("score").alias("score"), best.alias("b"), F.min("pos").alias("first"))
    place = F.row_number().over(Window.orderBy(F.desc("votes"), F.desc("score"), "first")).cast("long")
    return g.withColumn("place", place).where(F.col("place") <= most).select("place", "code", "votes", "score", "b.*")


def by_expert(results: DataFrame) -> DataFrame:
    """(expert, pos, at, code, name, stars, score, voter): the picks of all models' experts as rows by expert.

    results: model, pos, logs (array of (expert, picks: array of (code, name, score))).  code and name null are '', score null 70,
    stars 3, model null 'unknown'.  Rows, not one array an expert: an expert that all models ask is no hot row.
    """
    x = results.select(F.coalesce("model", F.lit("unknown")).alias("voter"), "pos", F.posexplode("logs").alias("_i", "l"))
    x = x.select("voter", "pos", "_i", F.col("l.expert").alias("expert"), F.posexplode("l.picks").alias("_j", "p"))
    text = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    return x.select("expert", "pos", F.struct("_i", "_j").alias("at"), text("code"), text("name"), F.lit(3.0).alias("stars"), F.coalesce(F.col("p.score").cast("double"), F.lit(70.0)).alias("score"), "voter")


def _fragments(text: Column, turns: tuple[str, ...], from_start: bool) -> Column:
    """The clause that begins with each turn's first place, at the very beginning only if from_start; null for none or too short."""
    at = lambda m: F.instr(text, m)
    clause = lambda m: F.trim(F.regexp_extract(F.substr(text, F.greatest(at(m), F.lit(1))), CLAUSE, 0))
    found = lambda m: F.when((at(m) > (0 if from_start else 1)) & (F.length(clause(m)) >= SHORTEST_RISK), clause(m))
    return F.array_compact(F.array(*[found(m) for m in turns]))


def debated(debates: DataFrame) -> DataFrame:
    """(code, model, score, reason, risk): the best opinion of each code and the risks that it and the others name.

    debates: code, model, pos, score, reasoning, experts (array), baseline, conservative, stop_loss_pct; one row for each model
    and code.  Best is the greatest score (null is 0), the first by pos of equals.  reason is its text, with the experts and
    the target (baseline, else conservative; 0 and null are none) in brackets.  risk: the clauses of the best text that begin
    with one of OWN_TURNS, not at its start; then of each other model's text, in order, the first clause with one of
    OTHER_TURNS that is not there yet; then the stop loss; the first RISKS of them.  A code's opinions, one for each model, are
    held together.
    """
    d = debates.select("code", F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), (-F.col("pos")).alias("turn"), "model", F.coalesce("reasoning", F.lit("")).alias("text"), "experts", "baseline", "conservative", "stop_loss_pct").alias("d"))
    g = d.groupBy("code").agg(F.max_by("d", F.struct("d.score", "d.turn")).alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("d.turn")).alias("pos"), F.col("d.model").alias("model"), F.col("d.text").alias("text")))).alias("all"))
    best = F.col("best")
    target = F.coalesce(F.nullif(best["baseline"].cast("double"), F.lit(0.0)), F.nullif(best["conservative"].cast("double"), F.lit(0.0)))
    experts = F.when(F.size("best.experts") > 0, F.concat(F.array_join("best.experts", "+"), F.lit("推荐")))
    suffix = F.concat_ws(", ", experts, F.when(target.isNotNull(), F.concat(F.lit("目标"), F.bround(target).cast("long"))))
    reason = F.concat(best["text"], F.when(suffix != "", F.concat(F.lit(" ("), suffix, F.lit(")"))).otherwise(""))
    own = F.array_distinct(_fragments(best["text"], OWN_TURNS, False))
    others = F.transform(F.filter("all", lambda o: o["model"] != best["model"]), lambda o: _fragments(o["text"], OTHER_TURNS, True))

    def more(parts: Column, found: Column) -> Column:
        return F.concat(parts, F.slice(F.array_except(found, parts), 1, 1))

    parts = F.aggregate(others, own, more)
    stop = F.when(best["stop_loss_pct"].cast("double") != 0, F.array(F.concat(F.lit("止损"), best["stop_loss_pct"].cast("string"), F.lit("%")))).otherwise(F.array().cast("array<string>"))
    return g.select("code", best["model"].alias("model"), best["score"].alias("score"), reason.alias("reason"), F.array_join(F.slice(F.concat(parts, stop), 1, RISKS), "；").alias("risk"))


def debate_context(answers: DataFrame) -> DataFrame:
    """(model, pos, line): a readable line for each model's answer, its picks or the beginning of its text.

    answers: model, pos, text, picks (array of (code, name, score, stars, reasoning), null where the text had none).  Picks are
    named with code, name if there is one, stars, score and 80 characters of the reasoning; what is null is '?' (texts are '').
    """
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    one = lambda p: F.concat(F.lit("  • "), shown(p["code"]), F.when(p["name"] != "", F.concat(F.lit(" "), p["name"])).otherwise(""), F.lit("（"), shown(p["stars"]), F.lit("星/"), shown(p["score"]), F.lit("分）: "), F.substring(F.coalesce(p["reasoning"], F.lit("")), 1, 80))
    named = F.concat(F.lit("【"), F.col("model"), F.lit("】"))
    plain = F.concat(named, F.lit(": "), F.replace(F.substring(F.coalesce("text", F.lit("")), 1, 300), F.lit("\n"), F.lit(" ")), F.lit("..."))
    picked = F.when(F.size("picks") > 0, F.concat(named, F.lit("的选择：\n"), F.array_join(F.transform("picks", one), "\n"))).otherwise(F.concat(named, F.lit("未给出有效选择")))
    return answers.select("model", "pos", F.when(F.col("picks").isNull(), plain).otherwise(picked).alias("line"))


def sampled_members(members: DataFrame, sectors: int, most: int = 30) -> DataFrame:
    """(code, sector, place) of members(sector, sector_pos, pos, code): all of them, or `most` of each sector if they are too many.

    A code counts once, in the sector that names it first (by sector_pos, pos), which is its sector either way.  Only if these
    are more than sectors * most does the limit hold; it counts a sector's own list, codes of earlier sectors included.  The
    order is the lists', one behind the other; empty codes don't count.
    """
    x = members.withColumn("code", F.trim("code")).where("code <> ''")
    place = F.row_number().over(Window.partitionBy("sector_pos").orderBy("pos"))
    x = x.withColumn("_in", place)
    home = x.groupBy("code").agg(F.min_by("sector", F.struct("sector_pos", "pos")).alias("sector"))
    total = home.agg((F.count("*") > sectors * most).alias("many"))  # one row
    kept = x.crossJoin(F.broadcast(total)).where(~F.col("many") | (F.col("_in") <= most))
    first = kept.groupBy("code").agg(F.min(F.struct("sector_pos", "pos")).alias("at")).join(home, "code")
    return first.select("code", "sector", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


def filled_fields(rows: DataFrame, lookup: DataFrame, industries: DataFrame) -> DataFrame:
    """rows with borda_score, model_count, consensus_level and sector filled where they are missing.

    Missing is null, 0 or ''.  The first two come from lookup(code, borda_score, model_count, consensus_level, sector), else 0;
    the level from there, else from the filled count: 'strong' from 3, 'medium' from 2, else 'single'; the sector from there, else
    from industries(code, industry), else ''.  lookup and industries have one row a code.
    """
    up = lookup.select("code", *(F.col(c).alias(f"_{c}") for c in ("borda_score", "model_count", "consensus_level", "sector")))
    j = rows.join(up, "code", "left").join(industries.select("code", "industry"), "code", "left")
    number = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.col(f"_{c}").cast("double"), F.lit(0.0))
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    j = j.withColumns({"borda_score": number("borda_score"), "model_count": number("model_count").cast("long")})
    level = F.when(F.col("model_count") >= 3, "strong").when(F.col("model_count") >= 2, "medium").otherwise("single")
    j = j.withColumns({"consensus_level": F.coalesce(text("consensus_level"), text("_consensus_level"), level), "sector": F.coalesce(text("sector"), text("_sector"), "industry", F.lit(""))})
    return j.select(*rows.columns)


#: Amounts, in units of 1e8, that mark a fund as active among the gainers and on its own.
ACTIVE, BUSY = 5, 10


def active_sectors(gainers: DataFrame, listed: DataFrame, funds: DataFrame) -> DataFrame:
    """(sector, fund, name, change, amount, signal): sectors that their funds show as active, by change.

    gainers, listed: pos, code, name, change, amount; funds: code, sector.  Of a sector's gainers the one of greatest change
    stands for it (the first of equals; changes that are null are 0, as are amounts).  Each listed fund of such a sector with
    more than ACTIVE adds its mark to the signal, and the last of them its amount.  Other sectors are there if a listed fund
    has more than BUSY: the first that does begins the sector, later ones above ACTIVE add their mark and amount.  change is at
    2 places, amount in units of 1e8 at 2 places.  Order: change descending, gainers first, then as listed.
    """
    f = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    both = lambda d: d.withColumn("code", F.trim("code")).join(funds, "code").withColumns({"change": f("change"), "amount": f("amount")})
    top = both(gainers).groupBy("sector").agg(F.max_by(F.struct("code", "name", "change", "amount", "pos"), F.struct("change", -F.col("pos"))).alias("t"), F.min("pos").alias("first"))
    seen = both(listed).withColumn("units", F.col("amount") / 1e8)
    busy = F.min(F.when(F.col("units") > BUSY, F.col("pos"))).over(Window.partitionBy("sector"))
    j = seen.withColumn("busy", busy).join(top, "sector", "left")
    begins = F.col("t").isNull() & (F.col("pos") == F.col("busy"))
    marks = (F.col("units") > ACTIVE) & (F.col("t").isNotNull() | (F.col("pos") > F.col("busy")))
    g = j.groupBy("sector").agg(
        F.max(F.when(begins, F.struct("code", "name", "change", "amount", "pos"))).alias("own"), F.count_if(marks).alias("marks"), F.max_by(F.when(marks, F.col("amount")), F.when(marks, F.col("pos"))).alias("marked"),
    )
    g = g.join(top, "sector", "full").where("t is not null or own is not null")
    who = F.coalesce("t", "own")
    amount = F.coalesce("marked", who["amount"])
    signal = F.concat(F.when(F.col("t").isNotNull(), "gainer").otherwise("volume"), F.repeat(F.lit("+active"), F.coalesce("marks", F.lit(0)).cast("int")))
    order = [F.round(who["change"], 2).desc(), F.col("t").isNull(), F.coalesce("first", F.col("own.pos"))]
    g = g.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return g.select("place", "sector", who["code"].alias("fund"), who["name"].alias("name"), F.round(who["change"], 2).alias("change"), F.round(amount / 1e8, 2).alias("amount"), signal.alias("signal"))


def panel_members(providers: DataFrame, priority: tuple[str, ...], most: int, chosen: tuple[str, ...] = ()) -> DataFrame:
    """(place, provider): the first `most` of providers(pos, provider), those of the priority list first, the rest by pos.

    chosen: a user's own list, which stands in for all of that, in its order, whether the providers are there or not.
    """
    spark = providers.sparkSession
    if chosen:
        rows = spark.createDataFrame(list(enumerate(chosen)), "at int, provider string").select(F.col("at").cast("long").alias("at"), F.lit(0).cast("long").alias("pos"), "provider")
    else:
        order = F.coalesce(F.create_map(*[x for k, name in enumerate(priority) for x in (F.lit(name), F.lit(k))])[F.col("provider")], F.lit(len(priority))) if priority else F.lit(0)
        rows = providers.groupBy("provider").agg(F.min("pos").alias("pos")).select(order.cast("long").alias("at"), "pos", "provider")
    place = F.row_number().over(Window.orderBy("at", "pos")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= most).select("place", "provider")


#: Marks in the details of a buy signal and of a rising wave.
FIRST_POINT, RISING_BOTH = "1p", "量价齐升"


def report_order(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """rows with priority and place: both signals, a first point, rising price and volume, a buy alone, others; by pos within.

    rows: chan_buy, wave_bull (boolean), chan_buy_detail, wave_bull_detail; null is false or ''.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    says = lambda c, mark: F.coalesce(F.col(c).contains(mark), F.lit(False))
    priority = F.when(yes("chan_buy") & yes("wave_bull"), 0).when(says("chan_buy_detail", FIRST_POINT), 1).when(says("wave_bull_detail", RISING_BOTH), 2).when(yes("chan_buy"), 3).otherwise(4)
    x = rows.withColumn("priority", priority)
    return x.withColumn("place", F.row_number().over(Window.orderBy("priority", pos)).cast("long"))
