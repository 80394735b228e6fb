"""Batch scoring of requests: resolve, expand over matching dates and minutes, average, summarise."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct.functions.calendar import first_matching_date, matching_dates, weekday_number
from precinct.functions.scalars import fingerprint, title, zero_pad
from precinct.operators.evaluation import top_probabilities
from precinct.operators.relational import with_area
from precinct.schema import HIGH_SEVERITY, MODERATE_SEVERITY, severity
from precinct.session import store

# Minutes that share the weight not given to the full hour.
OTHER_MINUTES = (10, 20, 30, 40, 50)
LOW_CONFIDENCE = 0.4
# Inputs of a request as resolved; ``date`` is the first matching time, also when the row has been expanded.
RESOLVED = ("first_date", "location_description", "district", "community_area", "area_name", "dayOfWeek", "hourOfDay", "request_month", "request_year")


def resolve_requests(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """Incident-shaped row per request: first matching date, defaults from the area dimension."""
    r = with_area(requests, areas, "communityArea")
    when = first_matching_date(F.col("year"), F.col("month"), weekday_number(F.col("dayOfWeek")), F.col("hourOfDay"))
    return r.select(
        "request_id", when.alias("date"), when.alias("first_date"), F.col("locationDescription").alias("location_description"), "beat",
        F.coalesce("district", "area_district").alias("district"), "ward",
        F.col("communityArea").alias("community_area"), F.coalesce("latitude", "area_lat").alias("latitude"),
        F.coalesce("longitude", "area_lon").alias("longitude"), "domestic",
        F.col("area_name"), "dayOfWeek", "hourOfDay", F.col("month").alias("request_month"),
        F.col("year").alias("request_year"))


def expand_requests(resolved: DataFrame, on_hour_share: Column) -> DataFrame:
    """One row per matching weekday of the month and per typical minute, with its weight.

    A request yields at most 5 dates x 6 minutes; the weights of a request sum to one.
    """
    dates = matching_dates(F.col("request_year"), F.col("request_month"), F.weekday("date"), F.hour("date"))
    rest = (F.lit(1.0) - F.col("__on_hour")) / float(len(OTHER_MINUTES))
    minutes = F.array(F.struct(F.lit(0).alias("m"), F.col("__on_hour").alias("w")),
                      *[F.struct(F.lit(m).alias("m"), rest.alias("w")) for m in OTHER_MINUTES])
    spread = (resolved.withColumns({"__on_hour": on_hour_share, "__dates": dates})
              .withColumns({"__n": F.size("__dates"), "__minute": F.explode(minutes)})
              .withColumn("__date", F.explode("__dates")))
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.col("__minute.m"))
    return (spread.withColumns({"date": F.col("__date") + shift, "weight": F.col("__minute.w") / F.col("__n")})
            .drop("__on_hour", "__dates", "__n", "__minute", "__date"))


def average_probabilities(scored: DataFrame, classes: list[str], key: str = "request_id", keep=()) -> DataFrame:
    """Weighted mean probability per request: one conditional-free sum per class, no exploding of classes.

    ``keep`` names columns that are equal in all rows of a request and stay with it.  The weights of a request add up to
    one; more than that means that two requests share an id, which is an error.
    """
    sums = [(F.sum(F.col("probability")[i] * F.col("weight")) / F.sum("weight")).alias(f"p{i}")
            for i in range(len(classes))]
    means = scored.groupBy(key).agg(*sums, *[F.first(c).alias(c) for c in keep], F.sum("weight").alias("__total"))
    repeated = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string"))).cast(scored.schema[key].dataType)
    return means.select(F.when(F.col("__total") > 1.5, repeated).otherwise(F.col(key)).alias(key), F.array(*[F.col(f"p{i}") for i in range(len(classes))]).alias("probability"), *keep)


def averaged_over(day: Column, month: Column, year: Column, hour: Column) -> Column:
    """The times a request's probabilities are averaged over, in words."""
    name = F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")
    at = zero_pad(hour)
    return F.concat(F.lit("every "), day, F.lit(" in "), name, F.lit(" "), year.cast("string"), F.lit(" at "), at, F.lit(":00-"), at, F.lit(":59"))


def long_probabilities(averaged: DataFrame, classes: list[str], key: str = "request_id") -> DataFrame:
    names = F.array(*[F.lit(c) for c in classes])
    return (averaged.select(key, F.posexplode("probability").alias("i", "p"))
            .select(key, names[F.col("i")].alias("category"), "p"))


def summarise(averaged: DataFrame, classes: list[str], k: int = 5, high=HIGH_SEVERITY, moderate=MODERATE_SEVERITY,
              model: str = "final") -> DataFrame:
    """Top classes with rounded probabilities, predicted class, confidence, severity, and the inputs as resolved.

    ``averaged`` carries the resolved inputs (RESOLVED), so that they are not worked out and joined a second time.
    """
    tops = top_probabilities(averaged, classes, k, keep=["request_id", *RESOLVED])
    rounded = F.transform("top", lambda t: F.struct(t["category"].alias("category"),
                                                    F.round(t["probability"], 3).alias("probability")))
    answer = tops.select("request_id", *RESOLVED, rounded.alias("top"))
    first = F.col("top")[0]
    return (answer.withColumns({"predicted": first["category"], "confidence": first["probability"], "model_name": F.lit(model)})
            .withColumns({"severity": severity(F.col("predicted"), high, moderate),
                          "area": F.concat("area_name", F.lit(" ("), F.col("community_area").cast("string"), F.lit(")")),
                          "averaged_over": averaged_over(F.col("dayOfWeek"), F.col("request_month"), F.col("request_year"), F.col("hourOfDay"))}))


def recommend(summary: DataFrame, low_confidence: float = LOW_CONFIDENCE) -> DataFrame:
    """Advice lines: two always, one more when unsure, one more for a High class."""
    name, hour = title(F.col("predicted")), zero_pad(F.col("hourOfDay"))
    share = F.concat(F.bround(F.col("confidence") * 100, 0).cast("long").cast("string"), F.lit("%"))
    after = [title(F.col("top")[i]["category"]) for i in (1, 2)]
    lines = F.array(
        F.concat(F.lit("Most likely in "), F.col("area_name"), F.lit(": "), name, F.lit(" ("), share, F.lit(").")),
        F.concat(F.lit("District "), F.col("district").cast("string"), F.lit(": brief patrols on "), name,
                 F.lit(" for "), F.col("dayOfWeek"), F.lit("s around "), hour, F.lit(":00.")),
        F.when(F.col("confidence") < low_confidence,
               F.concat(F.lit("Low confidence: also prepare for "), F.concat_ws(", ", *after), F.lit("."))),
        F.when(F.col("severity") == "High", F.lit("Violent class: consider a visible patrol presence.")))
    return summary.select("request_id", F.array_compact(lines).alias("recommendations"))


def interim_features(resolved: DataFrame) -> DataFrame:
    """Inputs of the interim model: absent ward is 0, absent beat is derived from the district."""
    weekday = F.weekday("date")
    return resolved.select(
        "request_id", F.hour("date").alias("hour"), F.month("date").alias("month"), weekday.alias("day_of_week"),
        (weekday >= 5).cast("int").alias("is_weekend"), F.col("domestic").cast("int").alias("domestic"),
        "community_area", "district", F.coalesce("ward", F.lit(0)).alias("ward"),
        F.coalesce("beat", F.col("district") * 100 + 11).alias("beat"), "latitude", "longitude",
        "location_description")


# What a model over incident rows looks at besides the time; of the time it sees month, day, weekday, hour and minute.
SCORED_ON = ("location_description", "beat", "district", "ward", "community_area", "latitude", "longitude", "domestic")


def _vector(inputs) -> Column:
    """Fingerprint of all that the model sees of a row."""
    when = F.col("date")
    return fingerprint(F.month(when), F.dayofmonth(when), F.weekday(when), F.hour(when), F.minute(when), *[F.col(c) for c in inputs])


def distinct_inputs(rows: DataFrame, inputs=SCORED_ON) -> DataFrame:
    """One row per distinct input of the model: its fingerprint ``vector``, a date that has its parts, and the inputs.

    Equal rows collapse before the shuffle, so an input that a third of the requests share costs one row per task.
    """
    return rows.groupBy(_vector(inputs).alias("vector")).agg(F.min("date").alias("date"), *[F.first(c).alias(c) for c in inputs])


def score_distinct(rows: DataFrame, model, inputs=SCORED_ON, key: str = "request_id") -> DataFrame:
    """(key, weight, probability) of expanded rows; the model runs once per distinct input.

    The answers are stored and joined back by fingerprint: a narrow join whose hot inputs AQE splits on the side of the rows.
    """
    answers = store(model.transform(distinct_inputs(rows, inputs)).select("vector", "probability"))
    return rows.select(key, "weight", _vector(inputs).alias("vector")).join(answers, "vector").drop("vector")


def score(rows: DataFrame, model) -> DataFrame:
    """Apply a fitted model (anything with ``transform`` that adds ``probability``) to expanded rows."""
    return model.transform(rows)
