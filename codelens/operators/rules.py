"""Ordered business rules over invoices.

Invoices come flat (one row each) with their items either nested
(``items array<struct>``) or as a separate item table keyed by invoice.  The
item table path never collects items into arrays: per-invoice flags are
``max`` aggregations with map-side combine, so an invoice with millions of
items is pre-aggregated before the shuffle.  Lookups (credit, allowed
companies) are equi-joins -- broadcast by the planner only when its size
estimate allows.  Each rule yields a nullable violation struct; the
pipeline is ``coalesce`` in rule order, so the first failure wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# ---------------------------------------------------------------------------
# Violation kinds (code text of each kind).
# ---------------------------------------------------------------------------
ERR_POS_AMOUNT = "paid amount + write off amount cannot be greater than grand total"
ERR_CREDIT_LIMIT = "customer credit limit exceeded"
ERR_DROP_SHIP = "stock cannot be updated for drop shipping items"
ERR_INTER_COMPANY = "invalid entity for inter company transaction"
ERR_INVALID_QTY = "item quantity cannot be zero"   # declared kind; no rule uses it
POS_DETAILS = "total paid %s exceeds invoice total %s"
# ---------------------------------------------------------------------------

RULE_ORDER = ("pos", "credit", "dropship", "intercompany")


def violation(code: str, details: Column | None = None) -> Column:
    return F.struct(F.lit(code).alias("code"),
                    (details if details is not None else F.lit("")).alias("details"))


# V1 ------------------------------------------------------------------------
def pos_violation(is_return="is_return", grand_total="grand_total", rounded_total="rounded_total",
                  paid="paid_amount", write_off="write_off", precision="precision_gt",
                  use_tolerance: bool = True) -> Column:
    """Returns only: total = rounded total if > 0 else grand total; fail iff
    paid + write-off - total > tolerance (strict).  An unset amount or
    precision is 0."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    total = F.when(c(rounded_total) > 0, c(rounded_total)).otherwise(c(grand_total))
    paid_all = c(paid) + c(write_off)
    diff = paid_all - total
    limit = tx.tolerance(c(precision)) if use_tolerance else F.lit(0)
    details = F.format_string(POS_DETAILS, tx.money2(paid_all), tx.money2(total))
    return F.when(F.coalesce(F.col(is_return), F.lit(False)) & (diff > limit),
                  violation(ERR_POS_AMOUNT, details))


# item flags ----------------------------------------------------------------
def item_flags(items: DataFrame, invoice_key: str) -> DataFrame:
    """Per invoice: any item with neither order nor delivery note; any item
    delivered by the supplier.  Invoices without items get no row."""
    unlinked = (F.coalesce(F.col("sales_order"), F.lit("")) == "") & \
               (F.coalesce(F.col("delivery_note"), F.lit("")) == "")
    return items.groupBy(invoice_key).agg(
        F.max(unlinked.cast("int")).alias("_unlinked"),
        F.max(F.coalesce(F.col("delivered_by_supplier"), F.lit(False)).cast("int")).alias("_supplier"))


def nested_item_flags(items_col: str = "items") -> list[Column]:
    """Same flags from a nested items array, row-locally."""
    arr = F.coalesce(F.col(items_col), F.array())
    return [F.exists(arr, lambda i: (F.coalesce(i["sales_order"], F.lit("")) == "") &
                     (F.coalesce(i["delivery_note"], F.lit("")) == "")).cast("int").alias("_unlinked"),
            F.exists(arr, lambda i: F.coalesce(i["delivered_by_supplier"], F.lit(False)))
            .cast("int").alias("_supplier")]


def attach_item_flags(invoices: DataFrame, items: DataFrame | None, invoice_key: str,
                      item_key: str | None = None, items_col: str = "items") -> DataFrame:
    if items is None:
        return invoices.select("*", *nested_item_flags(items_col))
    flags = item_flags(items, item_key or invoice_key)
    if item_key and item_key != invoice_key:
        flags = flags.withColumnRenamed(item_key, invoice_key)
    return invoices.join(flags, invoice_key, "left") \
        .withColumn("_unlinked", F.coalesce("_unlinked", F.lit(0))) \
        .withColumn("_supplier", F.coalesce("_supplier", F.lit(0)))


# V2 ------------------------------------------------------------------------
def attach_credit(invoices: DataFrame, credit: DataFrame, keys: list[str]) -> DataFrame:
    """Lookup port: ``credit(keys..., exceeded boolean)``.  Repeated lookup
    rows are one: exceeded if any of them says so, null if none says."""
    cr = credit.groupBy(*keys).agg(F.max("exceeded").alias("_exceeded")).withColumn("_credit_found", F.lit(True))
    return invoices.join(cr, keys, "left")


def credit_violation(bypass="bypass_credit", missing_is_violation: bool = True) -> Column:
    """Needed when not bypassed or any item is unlinked; then the lookup
    decides.  A customer missing from the lookup counts as a failed lookup."""
    needed = ~F.coalesce(F.col(bypass), F.lit(False)) | (F.col("_unlinked") == 1)
    failed = F.coalesce(F.col("_exceeded"), F.lit(missing_is_violation))
    return F.when(needed & failed, violation(ERR_CREDIT_LIMIT))


# V3 ------------------------------------------------------------------------
def dropship_violation(update_stock="update_stock") -> Column:
    return F.when(F.coalesce(F.col(update_stock), F.lit(False)) & (F.col("_supplier") == 1),
                  violation(ERR_DROP_SHIP))


# V4 ------------------------------------------------------------------------
def attach_allowed(invoices: DataFrame, allowed: DataFrame, customer="customer",
                   company="company") -> DataFrame:
    """Membership of (customer, company) in the allowed-companies table as an
    equi-join -- the same answer as ``array_contains`` on the customer's
    list, without building a per-customer array."""
    a = allowed.select(F.col(customer), F.col(company)).distinct() \
        .withColumn("_allowed", F.lit(True))
    return invoices.join(a, [customer, company], "left")


def attach_allowed_list(invoices: DataFrame, allowed_lists: DataFrame, customer="customer",
                        company="company", list_col="allowed") -> DataFrame:
    """Same for a registry that already stores ``allowed array<string>``
    per customer (F18); a missing or null list means not allowed."""
    a = allowed_lists.select(F.col(customer), F.col(list_col).alias("_list"))
    return invoices.join(a, customer, "left") \
        .withColumn("_allowed", tx.list_contains("_list", company)).drop("_list")


def intercompany_violation(ref="inter_company_ref", internal="is_internal") -> Column:
    needs = (F.coalesce(F.col(ref), F.lit("")) == "") & F.coalesce(F.col(internal), F.lit(False))
    return F.when(needs & ~F.coalesce(F.col("_allowed"), F.lit(False)), violation(ERR_INTER_COMPANY))


# V5 ------------------------------------------------------------------------
def attach_lookups(invoices: DataFrame, items: DataFrame | None, credit: DataFrame,
                   allowed: DataFrame, invoice_key: str = "invoice_id", item_key: str | None = None,
                   credit_keys: tuple[str, ...] = ("customer", "company"), allowed_is_list: bool = False) -> DataFrame:
    """Item flags and both lookups joined to the invoices (one row each)."""
    df = attach_item_flags(invoices, items, invoice_key, item_key)
    df = attach_credit(df, credit, list(credit_keys))
    return attach_allowed_list(df, allowed) if allowed_is_list else attach_allowed(df, allowed)


def apply_rules(prepared: DataFrame, use_tolerance: bool = True) -> DataFrame:
    """All four rules over :func:`attach_lookups` output; adds ``v_pos,
    v_credit, v_dropship, v_intercompany`` and ``violation`` (first failure
    in rule order, null when none)."""
    df = (prepared.withColumn("v_pos", pos_violation(use_tolerance=use_tolerance))
          .withColumn("v_credit", credit_violation())
          .withColumn("v_dropship", dropship_violation())
          .withColumn("v_intercompany", intercompany_violation()))
    return df.withColumn("violation", F.coalesce("v_pos", "v_credit", "v_dropship", "v_intercompany"))


def validate(invoices: DataFrame, items: DataFrame | None, credit: DataFrame,
             allowed: DataFrame, invoice_key: str = "invoice_id", item_key: str | None = None,
             credit_keys: tuple[str, ...] = ("customer", "company"), use_tolerance: bool = True,
             allowed_is_list: bool = False) -> DataFrame:
    """V5: :func:`attach_lookups` then :func:`apply_rules`."""
    prepared = attach_lookups(invoices, items, credit, allowed, invoice_key, item_key, credit_keys,
                              allowed_is_list)
    return apply_rules(prepared, use_tolerance)


def violation_code(col: str = "violation") -> Column:
    return F.coalesce(F.col(col)["code"], F.lit("none"))
