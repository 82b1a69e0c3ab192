"""A corpus of business documents rendered from the star schema: up to four documents per order, whose analysis is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsift.session import spread, table


def rendered_docs(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_ix, file_name, source, text)``: of order k a purchase order (unless 5 divides k), an invoice, a receipt (if 3
    divides k) and a memo (if 10 divides k), with ``doc_ix`` 4 * k + 0 to 3."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice", F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    whole = spread(orders.join(customers, "o_custkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"), "k")
    say = lambda *parts: F.concat(*(F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts))
    whole = whole.withColumn("price", F.format_number("o_totalprice", 2)).withColumn("half", F.format_number(F.col("o_totalprice") * 0.5, 2)).withColumn("code", F.col("o_custkey") + 400_000)
    head = [say("$c_name", " Pvt Ltd"), say("$o_custkey", " Market Street, ", "$n_name", " ", "$code")]
    kinds = [
        (F.col("k") % 5 != 0, [*head, F.lit(""), F.lit("PURCHASE ORDER"), say("PO No: PO-", "$k"), say("Order Date: ", "$day"), F.lit("Vendor: Global Traders Inc")]),
        (F.lit(True), [*head, F.lit("GSTIN: 27ABCDE1234F1Z5"), F.lit(""), F.lit("TAX INVOICE"), say("Invoice No.: INV-", "$k"), say("Invoice Date: ", "$day"), say("PO Ref: PO-", "$k"), say("Subtotal: ", "$half"), say("Grand Total: ", "$price")]),
        (F.col("k") % 3 == 0, [F.lit("Zenith Retail LLP"), F.lit("CASH RECEIPT"), say("Reference No: INV-", "$k"), say("Date: ", "$day"), say("Amount Paid: ", "$price")]),
        (F.col("k") % 10 == 0, [F.lit("Meeting notes"), say("memo ", "$k")]),
    ]
    made = [F.when(kept, F.struct(F.lit(i).alias("kind"), F.concat_ws("\n", *lines).alias("text"))) for i, (kept, lines) in enumerate(kinds)]
    docs = whole.select("k", F.explode(F.array_compact(F.array(*made))).alias("d"))
    ix = F.col("k") * 4 + F.col("d.kind")
    return docs.select(ix.cast("bigint").alias("doc_ix"), F.concat(F.lit("doc_"), ix, F.lit(".pdf")).alias("file_name"), F.lit("text").alias("source"), "d.text")
