"""The concept catalog: which tags report a concept, how tags combine, and how it is derived."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

INCOME, BALANCE, CASH_FLOW = "income_statement", "balance_sheet", "cash_flow"
INSTANT, DURATION = "instant", "duration"
ALTERNATES, SCOPE, COMPONENTS = "alternates", "preferred_scope", "components"


@dataclass(frozen=True)
class Concept:
    """tags by priority; groups of alternatives and a total if they are components; signed rules of inputs."""

    name: str
    statement: str
    nature: str
    tags: tuple[str, ...] = ()
    policy: str = ALTERNATES
    rules: tuple[tuple[tuple[int, str], ...], ...] = ()
    total: str | None = None
    groups: tuple[tuple[tuple[str, ...], ...], ...] = ()


#: Concepts, their tags and derivation rules.
CONCEPTS = (
    Concept(
        "revenue", INCOME, DURATION,
        ("Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueGoodsNet", "SalesRevenueServicesNet"),
        SCOPE,
    ),
    Concept("cost_of_goods_sold", INCOME, DURATION, ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfGoodsSold"), SCOPE),
    Concept("gross_profit", INCOME, DURATION, ("GrossProfit",), rules=(((1, "revenue"), (-1, "cost_of_goods_sold")),)),
    Concept("operating_income", INCOME, DURATION, ("OperatingIncomeLoss",)),
    Concept("interest_expense", INCOME, DURATION, ("InterestExpense", "InterestExpenseNonoperating", "InterestExpenseDebt", "InterestAndDebtExpense"), SCOPE),
    Concept(
        "pretax_income", INCOME, DURATION,
        ("IncomeLossFromContinuingOperationsBeforeIncomeTaxesExtraordinaryItemsNoncontrollingInterest", "IncomeLossFromContinuingOperationsBeforeIncomeTaxesMinorityInterestAndIncomeLossFromEquityMethodInvestments"),
    ),
    Concept("ebit", INCOME, DURATION, rules=(((1, "pretax_income"), (1, "interest_expense")), ((1, "operating_income"),))),
    Concept("net_income", INCOME, DURATION, ("NetIncomeLoss", "ProfitLoss"), SCOPE),
    Concept("cash", BALANCE, INSTANT, ("CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalentsAtCarryingValueIncludingDiscontinuedOperations", "Cash")),
    Concept("accounts_receivable", BALANCE, INSTANT, ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent")),
    Concept("inventory", BALANCE, INSTANT, ("InventoryNet", "InventoryNetCurrent")),
    Concept("current_assets", BALANCE, INSTANT, ("AssetsCurrent",)),
    Concept("total_assets", BALANCE, INSTANT, ("Assets",)),
    Concept("current_liabilities", BALANCE, INSTANT, ("LiabilitiesCurrent",)),
    Concept("total_liabilities", BALANCE, INSTANT, ("Liabilities",), rules=(((1, "total_assets"), (-1, "total_equity")),)),
    Concept(
        "short_term_debt", BALANCE, INSTANT,
        ("DebtCurrent", "LongTermDebtCurrent", "LongTermDebtAndCapitalLeaseObligationsCurrent", "ShortTermBorrowings", "CommercialPaper", "OtherShortTermBorrowings", "NotesPayableCurrent"),
        COMPONENTS, total="DebtCurrent",
        groups=(
            (("LongTermDebtCurrent",), ("LongTermDebtAndCapitalLeaseObligationsCurrent",)),
            (("ShortTermBorrowings",), ("CommercialPaper", "OtherShortTermBorrowings"), ("NotesPayableCurrent",)),
        ),
    ),
    Concept("long_term_debt", BALANCE, INSTANT, ("LongTermDebtNoncurrent", "LongTermDebtAndCapitalLeaseObligations", "LongTermDebt"), SCOPE),
    Concept("total_debt", BALANCE, INSTANT, ("DebtLongtermAndShorttermCombinedAmount",), rules=(((1, "short_term_debt"), (1, "long_term_debt")),)),
    Concept("shareholders_equity", BALANCE, INSTANT, ("StockholdersEquity",), rules=(((1, "total_equity"), (-1, "noncontrolling_interest")),)),
    Concept("noncontrolling_interest", BALANCE, INSTANT, ("MinorityInterest",)),
    Concept(
        "total_equity", BALANCE, INSTANT, ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",),
        rules=(((1, "shareholders_equity"), (1, "noncontrolling_interest")), ((1, "shareholders_equity"),)),
    ),
    Concept("operating_cash_flow", CASH_FLOW, DURATION, ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"), SCOPE),
    Concept("capital_expenditures", CASH_FLOW, DURATION, ("PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsForCapitalImprovements", "PaymentsToAcquireProductiveAssets")),
    Concept("investing_cash_flow", CASH_FLOW, DURATION, ("NetCashProvidedByUsedInInvestingActivities", "NetCashProvidedByUsedInInvestingActivitiesContinuingOperations"), SCOPE),
    Concept("financing_cash_flow", CASH_FLOW, DURATION, ("NetCashProvidedByUsedInFinancingActivities", "NetCashProvidedByUsedInFinancingActivitiesContinuingOperations"), SCOPE),
    Concept("free_cash_flow", CASH_FLOW, DURATION, rules=(((1, "operating_cash_flow"), (-1, "capital_expenditures")),)),
)

#: Concepts that a filing opens with for years whose statements it doesn't present.
ROLL_FORWARD = ("cash", "shareholders_equity", "noncontrolling_interest", "total_equity")

#: Concepts whose amounts are never negative, and parts with their wholes.
NON_NEGATIVE = (
    "total_assets", "current_assets", "current_liabilities", "total_liabilities", "cash", "inventory", "accounts_receivable",
    "short_term_debt", "long_term_debt", "total_debt", "interest_expense", "cost_of_goods_sold", "capital_expenditures",
)
PART_WHOLE = (("current_assets", "total_assets"), ("current_liabilities", "total_liabilities"))


def tag_rows() -> list[tuple]:
    """(tag, concept, statement, nature, policy, priority, grp, alt); a total is of group 0, other parts count from 1."""
    out = []
    for c in CONCEPTS:
        place = {t: (g, a) for g, group in enumerate(c.groups, 1) for a, alternative in enumerate(group) for t in alternative}
        out += [(t, c.name, c.statement, c.nature, c.policy, i, *place.get(t, (0, 0))) for i, t in enumerate(c.tags)]
    return out


def tag_frame(spark: SparkSession) -> DataFrame:
    """tag_rows as a frame: of the catalog's size, so it may be broadcast."""
    return spark.createDataFrame(tag_rows(), "tag string, concept string, statement string, nature string, policy string, priority int, grp int, alt int")
