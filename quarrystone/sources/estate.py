"""An estate of sources rendered from relational tables, so that SQL can state the facts it holds.

Each part is a COBOL program, each supplier a leaf program (every tenth is missing), each nation a copybook, each
order a JCL job and each region a PL/I program. Literals, comments and blocks are planted by the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

A, B = " " * 7, " " * 11


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows by key over twice the cores, whatever their bytes: keys are few bytes, the texts made of them many."""
    spark = rows.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, key)


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    top = table(spark, sf_dir, "part").agg(F.max("p_partkey").alias("top"))
    pairs = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey"), "p_partkey").groupBy("p_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("supp"))
    base = k - 1 - (k - 1) % 7
    follower = base + ((k - 1) % 7 + 1) % 7 + 1
    ring = (((k - 1) / 7).cast("long") % 2 == 0) & (base + 7 <= F.col("top"))
    pick = lambda cond, yes, no: F.when(cond, yes if isinstance(yes, Column) else F.lit(yes)).otherwise(no if isinstance(no, Column) else F.lit(no))
    body = [
        F.lit(A + "IDENTIFICATION DIVISION."),
        text_of(A + "PROGRAM-ID. P", k, "."),
        F.lit("      * CALL 'GHOST' in a comment"),
        F.lit(A + "DATA DIVISION."),
        F.lit(A + "WORKING-STORAGE SECTION."),
        text_of(B + "COPY N", k % 25, "."),
        F.lit(A + "01  WS-TOTAL        PIC 9(7)V99."),
        F.lit(A + "05  WS-PGM-NAME     PIC X(8)."),
        F.lit(A + "PROCEDURE DIVISION."),
        F.lit(A + "MAIN-PARA."),
        pick(k % 7 == 0, B + "MOVE 'hunter2' TO WS-PASSWORD.", B + "CONTINUE."),
        pick(k % 5 == 0, B + "DISPLAY WS-CARD-NO.", B + "DISPLAY 'PASSWORD CALL NOBODY'."),
        pick(k % 3 == 0, B + "CALL WS-PGM-NAME.", B + "PERFORM X-IMS-CALL THRU Y."),
        F.when(k % 4 == 0, B + "EXEC CICS LINK").when(k % 4 == 1, B + "EXEC CICS XCTL").otherwise(B + "EXEC SQL"),
        F.when(k % 4 == 0, text_of(B + "  PROGRAM('S", k % 10 + 1, "')"))
        .when(k % 4 == 1, B + "  PROGRAM(WS-PGM-NAME)")
        .when(k % 4 == 2, text_of(B + "  SELECT A FROM T", k % 13, " JOIN U", k % 3))
        .otherwise(text_of(B + "  INSERT INTO T", k % 13, " SELECT B FROM V", k % 2)),
        F.lit(B + "END-EXEC."),
        pick(k % 6 == 0, B + "EXEC SQL EXECUTE IMMEDIATE :STMT END-EXEC.", B + "MOVE 1 TO WS-TOTAL."),
        F.lit(B + "EVALUATE WS-TOTAL"),
        F.lit(B + "  WHEN 1 CONTINUE"),
        pick(k % 2 == 0, B + "  WHEN OTHER CONTINUE", B + "  WHEN 2 CONTINUE"),
        F.lit(B + "END-EVALUATE"),
        pick(k % 11 == 0, text_of(B + "MOVE '10.0.", k % 300, ".7' TO WS-HOST."), B + "MOVE '1.2' TO WS-HOST."),
        pick(k % 9 == 0, B + "READY TRACE.", B + "MOVE 'EXHIBIT' TO WS-X."),
        F.when(ring, text_of(B + "CALL 'P", follower, "'.")).otherwise(text_of(B + 'CALL "S', k % 5 + 1, '".')),
        pick(k % 17 == 0, text_of(B + "CALL 'P", k, "'."), B + "GOBACK."),
        F.lit(A + "CALL-PARA."),
    ]
    calls = F.transform(F.coalesce("supp", F.array().cast("array<bigint>")), lambda s: text_of(B + "CALL 'S", s, "'."))
    made = parts.join(pairs, "p_partkey", "left").crossJoin(F.broadcast(top))  # top is one row
    return made.select(text_of("cobol/P", k, ".cbl").alias("rel_path"), F.concat(F.array_join(F.concat(F.array(*body), calls), "\n"), F.lit("\n")).alias("text"))


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    lead = F.when(n % 2 == 0, A).otherwise("")
    rows = [text_of(lead, x) for x in ("IDENTIFICATION DIVISION.",)] + [text_of(lead, "PROGRAM-ID. S", n, ".")]
    rows += [text_of(lead, x) for x in ("PROCEDURE DIVISION.", "LEAF-PARA.", "GOBACK.")]
    return table(spark, sf_dir, "supplier").filter(n % 10 != 0).select(text_of("cobol/S", n, ".cbl").alias("rel_path"), F.concat_ws("\n", *rows).alias("text"))


def copybooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def book(names: DataFrame, letter: str) -> DataFrame:
        n = F.col("n")
        rows = [text_of(A + "01  ", letter, n, "-REC."), text_of(A + "05  ", letter, n, "-ID PIC 9(6).")]
        return names.select(text_of("cobol/", letter, n, ".cpy").alias("rel_path"), F.concat_ws("\n", *rows).alias("text"))

    nations = book(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")), "N")
    return nations.unionByName(book(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n")), "Z"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = F.col("o_orderkey"), F.col("l_linenumber")
    items = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey")
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    step = F.concat_ws(
        "\n",
        text_of("//S", i, " EXEC PGM=P", F.col("l_partkey")),
        text_of("//D", i, " DD DSN=CUST.C", F.col("o_custkey"), ","),
        F.lit("//             DISP=SHR"),
    )
    steps = items.join(orders, "o_orderkey").groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", step.alias("s")))).alias("steps"))
    card = text_of("//J", o, " JOB (ACCT),CLASS=A", F.when(o % 20 == 0, text_of(",PASSWORD=PW", o % 7)).otherwise(F.lit("")))
    return (
        orders.join(steps, "o_orderkey", "left")
        .select(
            text_of("jcl/O", o, ".jcl").alias("rel_path"),
            F.array_join(F.concat(F.array(card, F.lit("//* EXEC PGM=GHOST")), F.coalesce(F.transform("steps", lambda x: x["s"]), F.array().cast("array<string>"))), "\n").alias("text"),
        )
    )


def pli_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_set("n_nationkey")).alias("n"))
    body = [
        text_of("R", r, ": PROC OPTIONS(MAIN);"),
        F.lit("  /* CALL GHOST; */"),
        F.lit("  DCL X CHAR(8);"),
        text_of("  %INCLUDE NINC", r, ";"),
        text_of("  CALL INNER", r, ";"),
        F.when(r % 2 == 0, "  PUT LIST(CARD_NO);").otherwise("  PUT LIST('CALL NOBODY');"),
        text_of("  INNER", r, ":"),
        F.lit("  PROC;"),
    ]
    calls = F.transform(F.coalesce("n", F.array().cast("array<int>")), lambda n: text_of("  CALL N_", n, ";"))
    return table(spark, sf_dir, "region").join(nations, "r_regionkey", "left").select(
        text_of("pli/R", r, ".pli").alias("rel_path"), F.array_join(F.concat(F.array(*body), calls), "\n").alias("text")
    )


def by_language(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """rel_path and text of the estate's COBOL, JCL and PL/I."""
    cobol = programs(spark, sf_dir).unionByName(leaves(spark, sf_dir)).unionByName(copybooks(spark, sf_dir))
    return [cobol, jobs(spark, sf_dir), pli_programs(spark, sf_dir)]


def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path and text of the whole estate."""
    cobol, jcl, pli = by_language(spark, sf_dir)
    return cobol.unionByName(jcl).unionByName(pli)
