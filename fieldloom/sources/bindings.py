"""Document corpora made from relational tables.

They give the operators input whose expected output is a plain query over the same tables.
Each builder is one narrow projection (after at most one aggregate or join), so a corpus scales
with its table. Only demonstrations, tests and benchmarks use them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


RULE = "=" * 30


class Tables:
    """Tables of one folder, read lazily by name: ``Tables(spark, path).orders``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        setattr(self, name, table)
        return table


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores before long texts are made of them: a small file would leave them in one task.

    The number of parts is given, as adaptive execution would join parts by the size that the rows have without their texts.
    """
    spark = rows.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts)


def page_header(n: Column) -> Column:
    return F.concat(F.lit(f"{RULE}\nPAGE "), n.cast("string"), F.lit(f"\n{RULE}\n"))


def materialized(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``text``, built once per row: a generated text is long, and its readers use it often.

    Inside a lambda the text is evaluated part by part. As code of the whole stage it would make one method of more than
    8,000 bytes, which Java never compiles. An outer explode does not test the size of the array first.
    """
    return rows.withColumn("_text", F.transform(F.array(F.lit(0)), lambda _: text)).withColumn("text", F.explode_outer("_text")).drop("_text")


def paged_documents(t: Tables) -> DataFrame:
    """Documents with every line as a page of its own."""
    pages = F.transform(F.split("text", "\n", -1), lambda line, i: F.concat(page_header(i + 1), line))
    return materialized(t.documents, F.array_join(pages, "\n")).select(
        "doc_id", "text", F.col("source").alias("subtype")
    )


def line_pages(t: Tables) -> DataFrame:
    """The same pages as an array column."""
    pages = F.transform(
        F.split("text", "\n", -1), lambda line, i: F.struct((i + 1).alias("page"), line.alias("text"))
    )
    return t.documents.select("doc_id", pages.alias("pages"), F.col("source").alias("subtype"))


def conversation_pages(t: Tables) -> DataFrame:
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text", "role"
    )


def benchmark_keys(t: Tables) -> DataFrame:
    """Template keys: each benchmark item is a key of one of the twenty document sources."""
    first = F.regexp_extract("text", r"([A-Za-z]+)", 1)
    return t.benchmark.select(
        F.col("item_id").cast("int").alias("key_id"),
        F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("subtype"),
        first.alias("key_name"), F.col("text").alias("key_desc"),
    )


# -------------------------------------------------------------------------- text for grids
def pct(hundredths: Column) -> Column:
    """Integer hundredths as percent text: 225 → ``2.25%``."""
    h = hundredths.cast("bigint")
    whole = F.floor(h / 100).cast("string")
    return F.concat(whole, F.lit("."), F.lpad(F.pmod(h, F.lit(100)).cast("string"), 2, "0"), F.lit("%"))


def grid_line(*cells: Column | str) -> Column:
    parts = [F.lit(c) if isinstance(c, str) else c for c in cells]
    return F.concat(F.lit("│ "), F.concat_ws(" │ ", *parts), F.lit(" │"))


FLAGS = ["A", "N", "R"]
GRID_COLUMNS = ["Mean Discount", "Mean Tax"]


def part_rates(t: Tables) -> DataFrame:
    """Mean discount and tax per part and return flag, in hundredths of a percent."""
    def mean(name: str, flag: str) -> Column:
        unit = F.when(F.col("l_returnflag") == flag, F.round(F.col(name) * 100).cast("bigint"))
        return F.floor((F.sum(unit) * 200 + F.count(unit)) / (F.count(unit) * 2))

    cols = [
        F.when(F.count_if(F.col("l_returnflag") == f) > 0, mean(c, f)).alias(f"{c[2:5]}_{f}")
        for f in FLAGS for c in ("l_discount", "l_tax")
    ]
    return t.lineitem.groupBy(F.col("l_partkey").alias("doc_id")).agg(*cols)


def _flag_rows() -> Column:
    rows = F.array(*[
        F.when(F.col(f"dis_{f}").isNotNull(), grid_line(f"Flag {f}", pct(F.col(f"dis_{f}")), pct(F.col(f"tax_{f}"))))
        for f in FLAGS
    ])
    return F.array_join(rows, "\n")


def html_documents(t: Tables) -> DataFrame:
    """The same rates as web tables: a title cell over all columns, a header row, a row per return flag."""
    def row(*cells: Column | str) -> Column:
        return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, F.lit("</td>")) for c in cells], F.lit("</tr>"))

    body = F.array_join(F.array(*[
        F.when(F.col(f"dis_{f}").isNotNull(), row(f"Flag {f}", pct(F.col(f"dis_{f}")), pct(F.col(f"tax_{f}")))) for f in FLAGS
    ]), "\n")
    title = F.concat(F.lit("<p>intro</p><table><tr><td colspan=3>Rates of part "), F.col("doc_id").cast("string"), F.lit("</td></tr>"))
    html = F.concat(title, row("Flag", "Mean Discount", "Mean Tax"), body, F.lit("</table>"))
    return spread(part_rates(t)).select("doc_id", html.alias("html"))


def grid_documents(t: Tables) -> DataFrame:
    """One text grid per part: title, header and a row per return flag."""
    text = F.concat(
        page_header(F.lit(1)), F.lit("Rates by return flag.\n\n[Table 1]\n┌──────┐\n"),
        grid_line(F.concat(F.lit("Rates of part "), F.col("doc_id").cast("string"))), F.lit("\n├──────┤\n"),
        grid_line("Flag", *GRID_COLUMNS), F.lit("\n"), _flag_rows(), F.lit("\n└──────┘\n"),
    )
    return materialized(spread(part_rates(t)), text).select("doc_id", "text")


def split_grid_documents(t: Tables) -> DataFrame:
    """The same grids with title and header on page 1 and the rows on page 2."""
    text = F.concat(
        page_header(F.lit(1)), F.lit("[Table 1]\n"),
        grid_line(F.concat(F.lit("Rates of part "), F.col("doc_id").cast("string"))), F.lit("\n"),
        grid_line("Flag", *GRID_COLUMNS), F.lit("\n"),
        page_header(F.lit(2)), F.lit("[Table 2]\n"), _flag_rows(), F.lit("\n"),
    )
    return materialized(spread(part_rates(t)), text).select("doc_id", "text")


# ------------------------------------------------------------------------------ agreements
CURRENCIES = {"1": "EUR", "2": "USD", "3": "GBP", "4": "CHF", "5": "JPY"}


def _letters(number: Column) -> Column:
    return F.translate(F.lpad(number.cast("string"), 9, "0"), "0123456789", "ABCDEFGHIJ")


def agreement_facts(t: Tables) -> DataFrame:
    """What each agreement says, one row per order.

    The facts are generated as one struct: as aliases, each would double the constraints that the optimizer
    derives for every plan above, and planning would take most of a query's time.
    """
    level = F.substring("o_orderpriority", 1, 1)
    currency = F.lit("JPY")
    for digit, code in CURRENCIES.items():
        currency = F.when(level == digit, code).otherwise(currency)
    amount = F.floor("o_totalprice").cast("bigint")
    status = F.col("o_orderstatus")
    period = F.when(status == "F", "Investment Grade Period").when(status == "O", "Borrowing Base Trigger Period")
    facts = F.struct(
        F.col("o_orderkey").alias("doc_id"), "o_orderstatus",
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("signed"),
        F.concat(F.lit("CUSTOMER "), _letters(F.col("o_custkey"))).alias("borrower"),
        F.concat(F.lit("BANK OF "), F.col("c_mktsegment")).alias("bank"),
        currency.alias("currency"), F.format_number(amount, 0).alias("amount"),
        F.initcap("c_mktsegment").alias("segment"), _letters(F.col("o_custkey")).alias("letters"),
        level.alias("level"), F.coalesce(period, F.lit("")).alias("period"),
        F.pmod(amount, F.lit(400)).alias("rate"),
    )
    signed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return spread(signed).select(F.inline_outer(F.array(facts)))


def agreements(t: Tables) -> DataFrame:
    """Three-page loan agreements with every kind of value the extractors know."""
    c = F.col
    lit = F.lit
    text = F.concat(
        page_header(lit(1)), lit("LOAN AGREEMENT\n\ndated as of "), c("signed"),
        lit("\n\nbetween\n"), c("borrower"), lit("\nand\n"), c("bank"), lit("\n(the parties)\n\n"),
        F.when(c("o_orderstatus") == "P", lit("")).otherwise(F.concat(
            c("borrower"), lit(' ("Borrower") and '), c("bank"), lit(' ("Bank") agree as follows.\n'))),
        lit("LOAN NUMBER LN-"), c("doc_id").cast("string"), lit("\nThe lender provides "), c("currency"), lit(" "),
        c("amount"), lit(" in total\nin support of the Borrower's "), c("segment"),
        lit(" Sector Reform Program\n\n"),
        page_header(lit(2)), lit('"Commitment Fee" means a fee equal to '), pct(c("rate") + 25),
        lit(' per annum on the undrawn amount.\n\n"Leverage Ratio" means the ratio of total debt to '
            "earnings for the period.\n\n"),
        F.when(c("period") == "", lit("The ")).otherwise(F.concat(lit("During any "), c("period"), lit(", the "))),
        lit("Borrower shall not permit the Leverage Ratio to be greater than "), c("level"),
        lit(" to 1 at the end of each quarter.\n\n[Table 1]\n"),
        grid_line("Pricing Grid"), lit("\n"), grid_line("Level", "Base Margin", "Peak Margin"), lit("\n"),
        grid_line("LIBOR Loans", pct(c("rate")), pct(c("rate") + 50)), lit("\n"),
        grid_line("ABR Loans", pct(c("rate") + 100), pct(c("rate") + 150)), lit("\n\n"),
        page_header(lit(3)), lit("[Table 2]\n"), grid_line("Level", "One", "Two", "Three", "Four"), lit("\n"),
        *[x for name, step in (("LIBOR Loans", 0), ("ABR Loans", 100), ("Commitment Fee Rate", 200)) for x in (
            grid_line(name, pct(c("rate") + step), pct(c("rate") + step + 1), F.rtrim(F.replace(
                pct(c("rate") + step + 2), lit("%"), lit(""))), pct(c("rate") + step + 3)), lit("\n"))],
        lit("\nFOR THE BORROWER\nName: Nadia "), c("letters"), lit("\nTitle: Minister of "), c("segment"),
        lit("\n\nFOR THE BANK\nBy: Omar "), c("letters"), lit("\nTitle: Country Director\n"),
    )
    return materialized(agreement_facts(t), text).select("doc_id", "text", F.lit("loan").alias("subtype"))


AGREEMENT_SECTIONS = [
    # topic, pages, type, keywords
    ("Parties and Dates", [1], "paragraph", ["agreement", "borrower", "amount", "number", "program", "currency"]),
    ("Pricing Grid", [2], "table", ["libor", "abr", "margin"]),
    ("Definitions and Covenants", [2], "paragraph", ["commitment", "fee", "leverage", "ratio"]),
]
AGREEMENT_KEYS = [
    # key_id, key_name, key_desc, search_type, expected_format
    (1, "Agreement Date", "", "", "date"),
    (2, "Borrower", "", "", "text"),
    (3, "Loan Amount", "", "", "currency"),
    (4, "Loan Number", "", "", "text"),
    (5, "Program Name", "", "", "text"),
    (6, "Commitment Fee", "", "", ""),
    (7, "LIBOR Loans Base Margin", "", "", "percentage"),
    (8, "Leverage Ratio Covenant", "", "", ""),
    (9, "Loan Principal Currency", "", "", "text"),
    (10, "Borrower", "", "keyword", ""),
]


def agreement_keys(spark: SparkSession) -> DataFrame:
    rows = [(k[0], "loan", *k[1:]) for k in AGREEMENT_KEYS]
    return spark.createDataFrame(
        rows, "key_id int, subtype string, key_name string, key_desc string, search_type string, expected_format string"
    )


def with_agreement_map(docs: DataFrame) -> DataFrame:
    sections = F.array(*[
        F.struct(
            F.lit(topic).alias("topic"), F.array(*map(F.lit, pages)).alias("pages"), F.lit(kind).alias("type"),
            F.array(*map(F.lit, kws)).alias("keywords"),
        )
        for topic, pages, kind, kws in AGREEMENT_SECTIONS
    ])
    return docs.withColumns({"sections": sections, "definition_pages": F.array(F.lit(2))})


# ------------------------------------------------------------------------ cascade branches
BRANCH_KEYS = [(21, "LIBOR Loans Base Margin", "", "", "percentage"), (22, "Governing Law", "", "", "text")]


def branch_keys(spark: SparkSession) -> DataFrame:
    rows = [(k[0], "branches", *k[1:]) for k in BRANCH_KEYS]
    return spark.createDataFrame(
        rows, "key_id int, subtype string, key_name string, key_desc string, search_type string, expected_format string"
    )


def branch_agreements(t: Tables) -> DataFrame:
    """Eight-page agreements with their maps; the order's number says in which place the margin stands (``variant``).

    0: a table with a rule beside it. 1: a page beside a table that lacks it, with a decoy on an earlier page. 2: a page that
    the map does not name. 3: nowhere. 4: a page that the map names, with a decoy on an earlier one.
    """
    facts = agreement_facts(t).withColumn("variant", F.col("doc_id") % 5)
    v, lit = F.col("variant"), F.lit
    means = lambda term, rate: F.concat(lit(f'"{term}" means a rate equal to '), pct(rate), lit(" per annum on the drawn amount.\n"))
    on = lambda variant, text: F.when(v == variant, text).otherwise(lit(""))
    rate, decoy = F.col("rate"), F.col("rate") + 700
    grid = F.concat(
        lit("[Table 1]\n"), grid_line("Margin Table"), lit("\n"), grid_line("Level", "Base Margin", "Peak Margin"), lit("\n"),
        grid_line("LIBOR Loans", pct(rate), pct(rate + 50)), lit("\n"), grid_line("ABR Loans", pct(rate + 100), pct(rate + 150)), lit("\n"),
    )
    page = lambda n, *parts: F.concat(page_header(lit(n)), *parts, lit("\n"))
    text = F.concat(
        page(1, lit("The parties have met.\n\n"), on(1, means("LIBOR Loans Base Margin", decoy)), on(4, means("LIBOR Loans Base Margin", decoy))),
        page(2, lit("The parties agree as follows.\n\n"), on(4, means("Base Margin", rate))),
        page(3, lit("GOVERNING LAW\n\nThe Governing Law shall be that of "), F.col("segment"), lit(" for all claims.\n")),
        page(4, lit("Left blank.\n")), page(5, lit("Left blank too.\n")),
        page(6, F.when(v == 0, grid).otherwise(lit("The table is withheld.\n"))),
        page(7, on(0, lit("The Base Margin for LIBOR Loans rises after a default.\n")), on(1, means("Base Margin", rate))),
        page(8, on(2, means("LIBOR Loans Base Margin", rate)), lit("End.\n")),
    )
    section = lambda topic, pages, kind, kws: F.struct(
        lit(topic).alias("topic"), F.array(*map(F.lit, pages)).alias("pages"), lit(kind).alias("type"), F.array(*map(F.lit, kws)).alias("keywords"))
    law = section("Law and Courts", [3], "paragraph", ["governing"])
    sections = (
        F.when(v.isin(0, 1), F.array(section("Margin Table", [6], "table", ["libor", "base"]), law))
        .when(v == 4, F.array(section("Margins", [2], "paragraph", ["libor", "base"]), law))
        .otherwise(F.array(section("Margins", [1], "paragraph", ["libor", "base"]), law))
    )
    return materialized(facts, text).select(
        "doc_id", "text", lit("branches").alias("subtype"), sections.alias("sections"), F.array().cast("array<int>").alias("definition_pages"))


# ---------------------------------------------------------------------- registry and results
def order_registry(t: Tables) -> DataFrame:
    """Orders as documents: F completed, O processing, P pending; lines are the keys."""
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count(F.lit(1)).cast("int").alias("total_keys"), F.max("l_shipdate").alias("shipped"),
        F.round(F.sum(F.round("l_quantity").cast("bigint")) / (F.count(F.lit(1)) * 50), 3).alias("avg_confidence"),
    )
    status = F.col("o_orderstatus")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    orders = t.orders.select(
        F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("document_type"),
        F.when(status == "F", "completed").when(status == "O", "processing").otherwise("pending").alias("status"),
        F.date_format("o_orderdate", iso).alias("created_at"),
    )
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name"))
    done = F.col("status") == "completed"
    return orders.join(names, "o_custkey").join(lines, "id", "left").select(
        "id", "name", "document_type", F.concat(F.lit("class "), F.substring("document_type", 1, 1)).alias("doc_subtype"), "status",
        F.when(done, "completed").when(F.col("status") == "processing", "extracting_fields").otherwise("queued")
        .alias("pipeline_step"),
        F.when(done, 100.0).otherwise(50.0).alias("progress"),
        "created_at",
        # every completed order with lines has an end date, some of them unreadable
        F.when(done & F.col("shipped").isNotNull(), F.when(
            F.col("document_type") == "5-LOW", "not a date").otherwise(F.date_format("shipped", iso)))
        .alias("completed_at"),
        "total_keys", F.when(done, F.col("total_keys")).otherwise(0).alias("processed_keys"),
        "avg_confidence", F.lit(3).alias("total_pages"),
        F.when(F.col("status") == "pending", "waiting").alias("error_msg"),
    )


def lineitem_results(t: Tables) -> DataFrame:
    """Line items as result rows."""
    c = F.col
    return t.lineitem.select(
        c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("key_id"),
        F.concat(F.lit("Rate "), c("l_returnflag"), F.lit("-"), c("l_linestatus")).alias("key_name"),
        F.lit("").alias("key_desc"),
        F.concat(F.round(c("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("value"),
        F.when(c("l_quantity") > 3, c("l_quantity") / 50).alias("score"),
        c("l_linenumber").cast("string").alias("page"),
        F.when(c("l_linestatus") == "F", "percentage").otherwise("text").alias("expected_format"),
        F.lit(True).alias("format_valid"), F.lit("from line item").alias("reason"),
        F.when(c("l_returnflag") == "A", "table").when(c("l_returnflag") == "N", "paragraph").otherwise("clause")
        .alias("found_in"),
        F.lit(None).cast("string").alias("rule_context"), c("l_suppkey").alias("supplier"),
    )


def event_changes(t: Tables) -> DataFrame:
    """Events as a registry change log: signups insert, errors delete, the rest update."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update")
    value = F.col("value").cast("string")
    fields = (
        F.when(kind == "signup", F.create_map(F.lit("status"), F.lit("pending"), F.lit("progress"), F.lit("0")))
        .when(kind == "click", F.create_map(F.lit("status"), F.lit("processing"), F.lit("progress"), value))
        .when(kind == "view", F.create_map(F.lit("progress"), F.lit(None).cast("string")))
        .when(kind == "purchase", F.create_map(F.lit("status"), F.lit("completed")))
    )
    return t.events.select(
        F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq"), op.alias("op"), fields.alias("fields"),
        F.col("event_type").alias("status"),
    )
