"""Claims generated from dictionaries: products of names, merchant templates, seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import draw, money_text


def names(surnames: DataFrame, given: DataFrame, between: str = "") -> DataFrame:
    """name: every surname with every given name; both are dictionaries of a few hundred rows."""
    return surnames.select("surname").crossJoin(F.broadcast(given.select("given"))).select(F.concat("surname", F.lit(between), "given").alias("name"))


def merchants(cities: DataFrame, brands: list[str], templates: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """canonical, aliases, city, brand, category of every city, brand, template (text, aliases, categories) and category of it."""
    kinds = F.array(*(F.struct(F.lit(text).alias("text"), F.array(*map(F.lit, aliases)).cast("array<string>").alias("also"), F.array(*map(F.lit, own)).alias("categories")) for text, aliases, own in templates))
    x = cities.select("city").withColumn("brand", F.explode(F.array(*map(F.lit, brands)))).select("city", "brand", F.inline(kinds)).withColumn("category", F.explode("categories"))
    fill = lambda t: F.replace(F.replace(F.replace(t, F.lit("{city}"), F.col("city")), F.lit("{brand}"), F.col("brand")), F.lit("{category}"), F.col("category"))
    return x.select(fill(F.col("text")).alias("canonical"), F.array_distinct(F.transform("also", fill)).alias("aliases"), "city", "brand", "category")


def numbered_id(prefix: str, date: str | Column, number: str | Column, width: int = 6) -> Column:
    """prefix, yyyymmdd and the number, which is never cut short."""
    n = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.lit(prefix), F.date_format(date, "yyyyMMdd"), F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0")))


def cases(spark: SparkSession, n: int, people: DataFrame, shops: DataFrame, kinds: list[tuple[str, float, float]], prefix: str, start: str, days: int) -> DataFrame:
    """n consistent claims: a person, an expense kind (name, least and most money), a merchant of that kind, dates in order, ids.

    Every draw is a hash of the claim's number, so a claim is the same wherever it is made. Dictionaries are numbered and
    joined by their numbers; they are small, and Spark decides whether to broadcast them.
    """
    number = lambda df, order, *by: df.withColumn("_k", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)) - 1).withColumn("_c", F.count("*").over(Window.partitionBy(*(by or [F.lit(0)]))))
    who = number(people, ["name"]).select(F.col("name").alias("applicant"), F.col("_k").alias("_person"))
    where = number(shops, ["city", "brand", "canonical"], "category").select("canonical", "aliases", "city", F.col("category").alias("expense_type"), F.col("_k").alias("_shop"), F.col("_c").alias("_shops"))
    pick = lambda tag, m: F.pmod(draw("id", tag), m if isinstance(m, Column) else F.lit(m))
    least, most = (F.array(*(F.lit(round(k[i] * 100)) for k in kinds)) for i in (1, 2))
    x = spark.range(1, n + 1).withColumn("_kind", pick("expense", len(kinds)).cast("int"))
    x = x.withColumns({
        "expense_type": F.get(F.array(*(F.lit(k[0]) for k in kinds)), F.col("_kind")), "amount": F.get(least, F.col("_kind")) + pick("money", F.get(most, F.col("_kind")) - F.get(least, F.col("_kind")) + 1),
        "order_date": F.date_add(F.to_date(F.lit(start)), pick("order", days).cast("int")),
    })
    later = lambda d, tag, m: F.date_add(d, pick(tag, m).cast("int"))
    x = x.withColumn("payment_date", later("order_date", "payment", 4)).withColumn("invoice_date", later("payment_date", "invoice", 6)).withColumn("application_date", later("invoice_date", "application", 15))
    total = people.agg(F.count("*").alias("_people"))
    x = x.crossJoin(F.broadcast(total)).withColumn("_person", pick("person", F.col("_people"))).join(who, "_person")
    x = x.join(where, "expense_type").where(F.col("_shop") == pick("merchant", F.col("_shops")))
    cents = F.expr("(amount * 6 + 50) div 100")
    case = F.lpad(F.col("id").cast("string"), 6, "0")
    return x.select(
        "id", F.concat(F.lit(f"{prefix}_"), F.when(F.length(F.col("id").cast("string")) > 6, F.col("id").cast("string")).otherwise(case)).alias("case_id"), "applicant", F.col("applicant").alias("payer"), F.col("applicant").alias("order_user"),
        F.col("canonical").alias("merchant"), "aliases", "city", "expense_type", *(money_text("amount").alias(c) for c in ("invoice_amount", "payment_amount", "reimbursement_amount", "order_amount")), money_text(cents).alias("tax_amount"),
        "order_date", "payment_date", "invoice_date", "application_date", numbered_id("INV", "invoice_date", "id").alias("invoice_id"), numbered_id("ORD", "order_date", "id").alias("order_id"), numbered_id("PAY", "payment_date", "id").alias("payment_id"),
    )
