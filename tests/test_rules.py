"""The reference's 13 leaf rule cases re-typed as rows (FIXTURES.md §2), plus
the edge cases listed there."""

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from codelens.functions import text as tx
from codelens.operators import rules

INV = ("invoice_id long, customer long, company string, is_return boolean, bypass_credit boolean, "
       "grand_total decimal(18,4), rounded_total decimal(18,4), paid_amount decimal(18,4), "
       "write_off decimal(18,4), precision_gt int, update_stock boolean, is_internal boolean, "
       "inter_company_ref string")
ITEMS = "invoice_id long, sales_order string, delivery_note string, delivered_by_supplier boolean"


def inv(i, **kw):
    base = dict(invoice_id=i, customer=i, company="C1", is_return=False, bypass_credit=False,
                grand_total=D(0), rounded_total=D(0), paid_amount=D(0), write_off=D(0), precision_gt=0,
                update_stock=False, is_internal=False, inter_company_ref="")
    base.update({k: (D(str(v)) if isinstance(v, (int, float)) and not isinstance(v, bool)
                     and k not in ("precision_gt", "customer", "invoice_id") else v) for k, v in kw.items()})
    return base


CASES = [  # (invoice, items, credit exceeded?, allowed companies, rule, expected code or None)
    (inv(1, paid_amount=500, grand_total=100), [], False, ["C1"], "v_pos", None),
    (inv(2, is_return=True, paid_amount=100, grand_total=100, precision_gt=2), [], False, ["C1"], "v_pos", None),
    (inv(3, is_return=True, paid_amount=100.50, grand_total=100, rounded_total=100.50, precision_gt=2), [], False,
     ["C1"], "v_pos", None),
    (inv(4, is_return=True, paid_amount=150, grand_total=100, precision_gt=2), [], False, ["C1"], "v_pos",
     rules.ERR_POS_AMOUNT),
    (inv(5, bypass_credit=True), [("SO-001", "", False)], True, ["C1"], "v_credit", None),
    (inv(6, bypass_credit=True), [("", "", False)], True, ["C1"], "v_credit", rules.ERR_CREDIT_LIMIT),
    (inv(7, update_stock=True), [("SO", "DN", True)], False, ["C1"], "v_dropship", rules.ERR_DROP_SHIP),
    (inv(8, update_stock=False), [("SO", "DN", True)], False, ["C1"], "v_dropship", None),
    (inv(9, is_internal=True), [], False, ["C2"], "v_intercompany", rules.ERR_INTER_COMPANY),
    (inv(10, is_internal=True), [], False, ["C1", "C2"], "v_intercompany", None),
    (inv(11, is_return=True, grand_total=100, paid_amount=50), [], False, ["C1"], "violation", None),
    # extra: difference exactly equal to the tolerance does not fail (strict)
    (inv(12, is_return=True, grand_total=100, paid_amount=100.001, precision_gt=2), [], False, ["C1"], "v_pos", None),
    (inv(13, is_return=True, grand_total=100, paid_amount=100.0011, precision_gt=2), [], False, ["C1"], "v_pos",
     rules.ERR_POS_AMOUNT),
    # extra: empty items do not force the credit check; without bypass the lookup decides
    (inv(14, bypass_credit=True), [], True, ["C1"], "v_credit", None),
    (inv(15, bypass_credit=False), [], True, ["C1"], "v_credit", rules.ERR_CREDIT_LIMIT),
    # extra: no allowed list at all is a failed lookup
    (inv(16, is_internal=True), [], False, None, "v_intercompany", rules.ERR_INTER_COMPANY),
    # extra: a reference skips the inter-company rule
    (inv(17, is_internal=True, inter_company_ref="REF"), [], False, None, "v_intercompany", None),
    # extra: several rules fail, the first in order wins
    (inv(18, is_return=True, grand_total=100, paid_amount=200, update_stock=True, is_internal=True),
     [("", "", True)], True, None, "violation", rules.ERR_POS_AMOUNT),
    (inv(19, update_stock=True, is_internal=True), [("SO", "", True)], True, None, "violation", rules.ERR_CREDIT_LIMIT),
]


@pytest.fixture(scope="module")
def validated(spark):
    invoices = spark.createDataFrame([c[0] for c in CASES], INV)
    items = spark.createDataFrame([(c[0]["invoice_id"], *it) for c in CASES for it in c[1]], ITEMS)
    credit = spark.createDataFrame([(c[0]["customer"], c[0]["company"], c[2]) for c in CASES],
                                   "customer long, company string, exceeded boolean")
    allowed = spark.createDataFrame([(c[0]["customer"], co) for c in CASES for co in (c[3] or [])],
                                    "customer long, company string")
    out = rules.validate(invoices, items, credit, allowed, invoice_key="invoice_id")
    return {r.invoice_id: r for r in out.collect()}


@pytest.mark.parametrize("case", CASES, ids=[str(c[0]["invoice_id"]) for c in CASES])
def test_rule_case(validated, case):
    row = validated[case[0]["invoice_id"]]
    got = row[case[4]]
    assert (got.code if got is not None else None) == case[5]


def test_pos_details_two_decimals(validated):
    assert validated[4]["v_pos"].details == "total paid 150.00 exceeds invoice total 100.00"


def test_nested_items_match_item_table(spark):
    invoices = spark.createDataFrame([c[0] for c in CASES], INV)
    nested_items = spark.createDataFrame(
        [(c[0]["invoice_id"], [dict(item_code="X", qty=1.0, sales_order=a, delivery_note=b, delivered_by_supplier=s)
                               for a, b, s in c[1]]) for c in CASES],
        "invoice_id long, items array<struct<item_code:string,qty:double,sales_order:string,"
        "delivery_note:string,delivered_by_supplier:boolean>>")
    credit = spark.createDataFrame([(c[0]["customer"], c[0]["company"], c[2]) for c in CASES],
                                   "customer long, company string, exceeded boolean")
    allowed_lists = spark.createDataFrame([(c[0]["customer"], c[3]) for c in CASES],
                                          "customer long, allowed array<string>")
    out = rules.validate(invoices.join(nested_items, "invoice_id"), None, credit, allowed_lists,
                         allowed_is_list=True)
    got = {r.invoice_id: (r.violation.code if r.violation else None) for r in out.collect()}
    for c in CASES:
        if c[4] == "violation":
            assert got[c[0]["invoice_id"]] == c[5]


def test_violation_text(spark):
    df = spark.createDataFrame([(rules.ERR_INVALID_QTY, "Qty is -5"), (rules.ERR_INVALID_QTY, "")],
                               "code string, details string")
    out = [r.t for r in df.select(tx.violation_text("code", "details").alias("t")).collect()]
    assert out == ["item quantity cannot be zero: Qty is -5", "item quantity cannot be zero"]


def test_unset_amounts_are_zero(spark):
    rows = spark.createDataFrame(
        [(1, True, D("100"), None, D("150"), None, None), (2, True, D("100"), D("0"), D("100"), None, 2)],
        "invoice_id long, is_return boolean, grand_total decimal(18,4), rounded_total decimal(18,4), "
        "paid_amount decimal(18,4), write_off decimal(18,4), precision_gt int")
    got = {r.invoice_id: r.v for r in rows.select("invoice_id", rules.pos_violation().alias("v")).collect()}
    assert got[1].code == rules.ERR_POS_AMOUNT and got[2] is None


def test_credit_lookup_by_customer_and_company(spark):
    invoices = spark.createDataFrame([(1, "c", "x"), (2, "c", "y"), (3, "d", "x")],
                                     "invoice_id long, customer string, company string")
    credit = spark.createDataFrame([("c", "x", False), ("c", "x", True), ("c", "y", False)],
                                   "customer string, company string, exceeded boolean")
    got = {r.invoice_id: r._exceeded for r in rules.attach_credit(invoices, credit, ["customer", "company"]).collect()}
    assert got == {1: True, 2: False, 3: None}
