"""Concept names of the filing taxonomy. Public tag names and the families they form."""

REVENUE_EXCL_TAX = "RevenueFromContractWithCustomerExcludingAssessedTax"
REVENUE_INCL_TAX = "RevenueFromContractWithCustomerIncludingAssessedTax"
REVENUES = "Revenues"
SALES_NET = "SalesRevenueNet"
INDUSTRY_TOTALS = ["RegulatedAndUnregulatedOperatingRevenue", "RevenuesNetOfInterestExpense"]
REVENUE_CHAIN = [REVENUE_EXCL_TAX, REVENUES, SALES_NET, REVENUE_INCL_TAX]
GROSS_PROFIT = "GrossProfit"
COST_CHAIN = ["CostOfRevenue", "CostOfGoodsAndServicesSold"]
OPERATING_INCOME = "OperatingIncomeLoss"
COSTS_AND_EXPENSES = "CostsAndExpenses"
OPERATING_EXPENSES = "OperatingExpenses"
NET_INCOME = "NetIncomeLoss"
RD = "ResearchAndDevelopmentExpense"
SBC = "ShareBasedCompensation"
OCF_CHAIN = ["NetCashProvidedByUsedInOperatingActivities",
             "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"]
CAPEX_CHAIN = ["PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets"]
DILUTED_SHARES = "WeightedAverageNumberOfDilutedSharesOutstanding"
BASIC_SHARES_CHAIN = ["WeightedAverageNumberOfSharesOutstandingBasic",
                      "WeightedAverageNumberOfShareOutstandingBasicAndDiluted"]
WEIGHTED_SHARE_TAGS = [DILUTED_SHARES, *BASIC_SHARES_CHAIN]

CASH = "CashAndCashEquivalentsAtCarryingValue"
SHORT_TERM_INVESTMENTS = "ShortTermInvestments"
EQUITY = "StockholdersEquity"
COVER_SHARES = "EntityCommonStockSharesOutstanding"

DEBT_COMBINED = "DebtLongtermAndShorttermCombinedAmount"
LTD = "LongTermDebt"
LTD_NONCURRENT = "LongTermDebtNoncurrent"
LTD_CURRENT = "LongTermDebtCurrent"
DEBT_CURRENT = "DebtCurrent"
SHORT_TERM_BORROWINGS = ["ShortTermBorrowings", "OtherShortTermBorrowings"]
# family -> (total, noncurrent, current); inside one list the names are variants of the same thing
SPECIFIC_FAMILIES = {
    "loc": (["LineOfCredit"], ["LongTermLineOfCredit"], ["LinesOfCreditCurrent"]),
    "notes": (["NotesPayable"], ["NotesPayableNoncurrent"], ["NotesPayableCurrent"]),
    "loans": ([], ["LongTermLoansPayable"], ["LoansPayableCurrent"]),
    "convertible": (["ConvertibleNotesPayable"],
                    ["ConvertibleDebtNoncurrent", "ConvertibleNotesPayableNoncurrent"],
                    ["ConvertibleDebtCurrent", "ConvertibleNotesPayableCurrent"]),
    "other": (["OtherLongTermDebt"], ["OtherLongTermDebtNoncurrent"], ["OtherLongTermDebtCurrent"]),
}
LEASED_SPANNING = "DebtAndCapitalLeaseObligations"
LEASED_NONCURRENT = "LongTermDebtAndCapitalLeaseObligations"
FINANCE_LEASES = {
    "spanning": ["FinanceLeaseLiability", "CapitalLeaseObligations"],
    "noncurrent": ["FinanceLeaseLiabilityNoncurrent", "CapitalLeaseObligationsNoncurrent"],
    "current": ["FinanceLeaseLiabilityCurrent", "CapitalLeaseObligationsCurrent"],
}
OPERATING_LEASES = ["OperatingLeaseLiability", "OperatingLeaseLiabilityCurrent", "OperatingLeaseLiabilityNoncurrent"]
LIABILITIES = ["Liabilities", "LiabilitiesCurrent"]

# tag -> (family, region)
DEBT_SHAPES = {
    DEBT_COMBINED: ("general", "spanning"),
    DEBT_CURRENT: ("general", "current"),
    **{t: ("general", "current") for t in SHORT_TERM_BORROWINGS},
    LTD: ("general", "spanning"),
    LTD_NONCURRENT: ("longterm", "noncurrent"),
    LTD_CURRENT: ("longterm", "current"),
    **{t: (family, region)
       for family, lists in SPECIFIC_FAMILIES.items()
       for region, names in zip(("spanning", "noncurrent", "current"), lists)
       for t in names},
}
CASH_SHAPES = {CASH: ("cash", "current"), SHORT_TERM_INVESTMENTS: ("short_term_investments", "current")}

FLOW_TAGS = [*REVENUE_CHAIN, *INDUSTRY_TOTALS, GROSS_PROFIT, *COST_CHAIN, OPERATING_INCOME, COSTS_AND_EXPENSES,
             OPERATING_EXPENSES, NET_INCOME, RD, SBC, *OCF_CHAIN, *CAPEX_CHAIN, *WEIGHTED_SHARE_TAGS]
INSTANT_TAGS = [CASH, SHORT_TERM_INVESTMENTS, EQUITY, COVER_SHARES, *DEBT_SHAPES,
                *[t for names in FINANCE_LEASES.values() for t in names], LEASED_SPANNING, LEASED_NONCURRENT]
TRACKED_TAGS = sorted({*FLOW_TAGS, *INSTANT_TAGS, *OPERATING_LEASES, *LIABILITIES})


def overlapping(tag: str, shapes: dict) -> list[str]:
    """Group tags whose measurement covers (part of) what ``tag`` measures."""
    family, region = shapes[tag]
    return [t for t, (f, r) in shapes.items()
            if (f == family or "general" in (f, family)) and (r == region or "spanning" in (r, region))]
