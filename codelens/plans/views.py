"""Stand-in inputs built from the test tables (FIXTURES.md §3.1).

Each view only reshapes test-table rows into the schema an operator expects
(files, hash state, chunks, queries, graph rows, invoices, lookups); none of
them does an operator's work.  Every view covers its whole source table:
the modulo expressions below assign file extensions, fake a stale hash, or
leave files out of one side of the delta -- they shape the scenario, they
do not thin the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.parallel import spread
from ..session import materialize, read_table


class Views:
    """Lazily built DataFrames over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    # Fact tables and a key to spread them on when a scan yields fewer
    # splits than the session's parallelism (a no-op at scale).
    SPREAD = {"lineitem": "l_orderkey", "orders": "o_orderkey", "documents": "doc_id", "embeddings": "vec_id"}

    def t(self, name: str) -> DataFrame:
        df = read_table(self.spark, self.sf_dir, name)
        return spread(df, [self.SPREAD[name]]) if name in self.SPREAD else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_"):
            if name not in self._cache:
                self._cache[name] = getattr(self, "_" + name)()
            return self._cache[name]
        raise AttributeError(name)

    # -- files and delta ----------------------------------------------------
    def _v_files(self) -> DataFrame:
        d = self.t("documents")
        ext = (F.when(F.col("doc_id") % 4 == 0, F.lit(".json"))
               .when(F.col("doc_id") % 4 == 3, F.lit(".txt")).otherwise(F.lit(".py")))
        return d.select("doc_id", F.concat(F.col("source"), F.lit("/doc_"),
                                           F.col("doc_id").cast("string"), ext).alias("path"),
                        F.col("text").alias("content"))

    def _v_prev_state(self) -> DataFrame:
        f = self.v_files.filter(F.col("doc_id") % 10 != 0)
        h = F.when(F.col("doc_id") % 7 == 0, F.lit("0" * 64)).otherwise(tx.content_hash("content"))
        return f.select("path", h.alias("content_hash"))

    def _v_cur(self) -> DataFrame:
        f = self.v_files.filter(F.col("doc_id") % 13 != 0)
        return f.select("doc_id", "path", "content", tx.content_hash("content").alias("content_hash"))

    def _v_chunks(self) -> DataFrame:
        f = self.v_files
        d = self.t("documents").select("doc_id", "lang")
        e = self.t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
        n_lines = 1 + F.length("content") - F.length(F.replace(F.col("content"), F.lit("\n"), F.lit("")))
        return (f.join(d, "doc_id").join(e, "doc_id", "left")
                .select(F.concat(F.col("path"), F.lit(":doc_"), F.col("doc_id").cast("string")).alias("id"),
                        "doc_id", F.col("path").alias("file_path"),
                        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("symbol_name"),
                        F.col("lang").alias("symbol_type"),
                        F.when(F.col("doc_id") % 5 == 0, F.lit("validate")).alias("hook_type"),
                        "content", F.lit(1).alias("start_line"), n_lines.cast("int").alias("end_line"),
                        "vector"))

    # -- queries --------------------------------------------------------------
    def _v_queries(self) -> DataFrame:
        b = self.t("benchmark")
        e = self.t("embeddings")
        return b.join(e, b.item_id == e.vec_id).select(
            F.col("item_id").alias("query_id"), F.col("text").alias("query"),
            F.col("embedding").alias("vector"))

    def _v_golden(self) -> DataFrame:
        e = self.t("embeddings")
        return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"),
                        F.concat(F.lit("LABEL\\"), F.col("label").cast("string"), F.lit("\\"))
                        .alias("expected_file"))

    def _v_paths(self) -> DataFrame:
        e = self.t("embeddings")
        return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
                        F.concat(F.lit("label/"), F.col("label").cast("string"), F.lit("/vec"),
                                 F.col("vec_id").cast("string")).alias("file_path"))

    # -- graph ----------------------------------------------------------------
    def _v_nodes(self) -> DataFrame:
        r = self.t("region")
        n = self.t("nation")
        c = self.t("customer")
        s = self.t("supplier")
        rid = F.replace(F.col("r_name"), F.lit(" "), F.lit("_"))
        nstr = F.lit(None).cast("string")
        files = r.select(rid.alias("node_id"), F.lit("file").alias("type"), F.col("r_name").alias("name"),
                         nstr.alias("parent_class"))
        rn = n.join(r, n.n_regionkey == r.r_regionkey)
        classes = rn.select(F.concat(rid, F.lit(":"), F.col("n_name")).alias("node_id"),
                            F.lit("class").alias("type"), F.col("n_name").alias("name"),
                            nstr.alias("parent_class"))
        cn = c.join(rn, c.c_nationkey == rn.n_nationkey)
        custs = cn.select(F.concat(rid, F.lit(":"), F.col("n_name"), F.lit(":"), F.col("c_name")).alias("node_id"),
                          F.lit("function").alias("type"), F.col("c_name").alias("name"),
                          F.col("n_name").alias("parent_class"))
        sn = s.join(rn, s.s_nationkey == rn.n_nationkey)
        supps = sn.select(F.concat(rid, F.lit(":"), F.col("n_name"), F.lit(":"), F.col("s_name")).alias("node_id"),
                          F.lit("function").alias("type"), F.col("s_name").alias("name"),
                          F.col("n_name").alias("parent_class"))
        # Read by many branches of the graph queries (containment, both ends
        # of every call edge, node selection): written once, read back.
        return materialize(files.unionByName(classes).unionByName(custs).unionByName(supps), "nodes")

    def _v_contains(self) -> DataFrame:
        from ..operators.graph import contains_edges
        return contains_edges(self.v_nodes)

    def _v_calls(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        o = self.t("orders").select("o_orderkey", "o_custkey")
        c = self.t("customer").select("c_custkey", "c_name")
        s = self.t("supplier").select("s_suppkey", "s_name")
        nodes = self.v_nodes.select("node_id", "name")
        cn = nodes.select(F.col("node_id").alias("src"), F.col("name").alias("c_name"))
        sn = nodes.select(F.col("node_id").alias("dst"), F.col("name").alias("s_name"))
        j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey).join(cn, "c_name").join(sn, "s_name"))
        return j.select("src", "dst", F.lit("CALLS").alias("type"), "l_orderkey", "l_linenumber", "l_partkey")

    def _v_defs(self) -> DataFrame:
        p = self.t("part")
        return p.select(F.col("p_name").alias("name"),
                        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("node_id"),
                        F.col("p_partkey").alias("ordinal"))

    def _v_sites(self) -> DataFrame:
        li = self.t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        p = self.t("part").select("p_partkey", "p_name")
        return li.join(p, li.l_partkey == p.p_partkey).select(
            F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("caller_id"),
            F.concat(F.lit("self."), F.col("p_name")).alias("raw_callee"),
            F.col("l_linenumber").alias("ordinal"))

    # -- invoices -------------------------------------------------------------
    def _v_items(self) -> DataFrame:
        li = self.t("lineitem")
        return li.select(
            "l_orderkey", "l_linenumber",
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("item_code"),
            F.col("l_quantity").alias("qty"),
            F.when(F.col("l_linestatus") == "O", F.lit(""))
            .otherwise(F.concat(F.lit("SO-"), F.col("l_orderkey").cast("string"))).alias("sales_order"),
            F.when(F.col("l_returnflag") == "N", F.lit(""))
            .otherwise(F.concat(F.lit("DN-"), F.col("l_orderkey").cast("string"))).alias("delivery_note"),
            (F.col("l_suppkey") % 10 == 0).alias("delivered_by_supplier"))

    def _v_invoice(self) -> DataFrame:
        o = self.t("orders")
        c = self.t("customer")
        dec = "decimal(18,4)"
        gt = F.col("o_totalprice").cast(dec)
        paid_delta = (F.when(F.col("o_orderkey") % 5 == 0, F.lit(0.0010).cast(dec))
                      .when(F.col("o_orderkey") % 5 == 1, F.lit(0.0011).cast(dec))
                      .otherwise(F.lit(-1.0).cast(dec)))
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("c_custkey").alias("customer"),
            F.concat(F.lit("Company-"), (F.col("o_orderkey") % 4).cast("string")).alias("company"),
            (F.col("o_orderstatus") == "F").alias("is_return"),
            F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("bypass_credit"),
            gt.alias("grand_total"),
            F.when(F.col("o_orderkey") % 3 == 0, F.round("o_totalprice", 0)).otherwise(F.lit(0.0))
            .cast(dec).alias("rounded_total"),
            (gt + paid_delta).cast(dec).alias("paid_amount"),
            F.when(F.col("o_orderkey") % 4 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).cast(dec).alias("write_off"),
            F.lit(2).alias("precision_gt"),
            F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("update_stock"),
            (F.col("c_nationkey") < 5).alias("is_internal"),
            F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.lit("REF")).alias("inter_company_ref"))

    def _v_credit(self) -> DataFrame:
        c = self.t("customer")
        # one row per customer and company; the last company's limit is looser
        return c.select(F.col("c_custkey").alias("customer"), "c_acctbal",
                        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")) \
            .select("customer", F.concat(F.lit("Company-"), F.col("k").cast("string")).alias("company"),
                    (F.col("c_acctbal") < F.when(F.col("k") == 3, F.lit(-500)).otherwise(F.lit(0))).alias("exceeded"))

    def _v_allowed(self) -> DataFrame:
        c = self.t("customer")
        a = c.select(F.col("c_custkey").alias("customer"),
                     F.concat(F.lit("Company-"), (F.col("c_custkey") % 4).cast("string")).alias("company"))
        b = c.select(F.col("c_custkey").alias("customer"),
                     F.concat(F.lit("Company-"), ((F.col("c_custkey") + 1) % 4).cast("string")).alias("company"))
        return a.unionByName(b).distinct()

    def _v_scores(self) -> DataFrame:
        lab = self.t("labels")
        return lab.select(F.col("doc_id").alias("query_id"), (F.col("quality") * 5).alias("accuracy"),
                          F.when(F.col("toxic") == 1, F.lit(None)).otherwise(F.lit(4)).alias("completeness"))
