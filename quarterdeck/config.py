"""Thresholds, weights and curves. Results must match them exactly."""

UNIVERSE = {
    "exchanges": ["N", "Q", "A"],
    "exclude_financial_status": ["D", "E", "Q"],
    "exclude_sic": ["6770"],
    "name_include": ["Common Stock", "Ordinary Shares"],
    "name_exclude": ["Preferred", "Warrant", "Unit", "Right", "Depositary", "% Note", "Trust Preferred"],
}

INGEST = {
    "bulk_quarters": 8,
    "publication_lag_days": 45,
    "stale_days": 120,
    "thin_coverage_min_facts": 200,
    "failure_rate_threshold": 0.5,
    "failure_min_sample": 20,
    "sample_size": 10,
}

RECONCILE = {
    "near_date_days": 20,
    "rel_tolerance": 0.005,
    "sparse_max_facts": 3,
    "sparse_dominance": 5,
    "instant_lookback_days": 400,
    "grid_gap_days": (60, 120),
    "max_span": 4,
    "quarter_days": 91.31,
    "span_tolerance_days": 20,
    "implausible_ratio": 2,
    "ttm_span_days": (240, 310),
    "cover_min_fraction_of_basic": 0.4,
    "shares_scale_error_factor": 100,
}

CLASSIFICATION = {
    "leader_ratio_of_max": 0.25,
    "leader_max": 5,
    "leader_min": 2,
    "leader_min_industry_candidates": 3,
    "challenger_min_market_cap": 2e9,
    "emerging_max_market_cap": 5e9,
    "emerging_revenue_threshold": 5e8,
}

STALENESS = {"price_days": 5, "financials_days": 120, "scores_days": 14}

QUALITY = {
    "revenue_decline_years": 2,
    "extreme_dilution": 0.50,
    "dilution_warning": 0.15,
    "gm_collapse_bps": 500,
    "sbc_of_revenue": 0.25,
    "debt_to_ebitda": 5,
    "runway_critical_quarters": 2,
    "runway_low_quarters": 6,
}

SCORING = {
    "min_completeness": 0.6,
    "wacc": 0.09,
    "tax_rate": 0.21,
    "min_industry_candidates": 3,
    "min_invested_capital_ratio": 0.10,
    "damping_curve": [(5e6, 0.40), (10e6, 0.55), (20e6, 0.70), (35e6, 0.85), (50e6, 1.00)],
    "revenue_growth": {
        "weight": 20,
        "blend": {"ttm_yoy": 0.6, "cagr_3y": 0.4},
        "curve": [(-0.10, 0.00), (0.00, 0.10), (0.15, 0.35), (0.25, 0.60), (0.40, 0.85), (0.60, 1.00)],
    },
    "revenue_acceleration": {
        "weight": 10,
        "curve": [(-0.20, 0.00), (-0.05, 0.25), (0.00, 0.45), (0.05, 0.70), (0.15, 0.90), (0.30, 1.00)],
    },
    "tam_industry_growth": {
        "weight": 15,
        "blend": {"tam_cagr": 0.6, "penetration": 0.4},
        "cagr_curve": [(0.00, 0.00), (0.05, 0.25), (0.10, 0.55), (0.15, 0.80), (0.25, 1.00)],
        "penetration_curve": [(0.00, 1.00), (0.05, 1.00), (0.15, 0.80), (0.30, 0.50), (0.50, 0.20), (1.00, 0.00)],
    },
    "gross_margin": {
        "weight": 10,
        "trend_quarters": 8,
        "blend": {"level": 0.6, "trend": 0.4},
        "level_curve": [(0.10, 0.00), (0.25, 0.25), (0.40, 0.50), (0.55, 0.75), (0.70, 0.95), (0.85, 1.00)],
        "trend_curve": [(-500, 0.00), (-100, 0.30), (0, 0.50), (100, 0.70), (300, 0.90), (600, 1.00)],
    },
    "operating_leverage": {
        "weight": 10,
        "blend": {"margin_delta": 0.5, "growth_gap": 0.5},
        "margin_delta_curve": [(-5, 0.00), (-1, 0.30), (0, 0.50), (2, 0.75), (5, 0.95), (10, 1.00)],
        "growth_gap_curve": [(-0.10, 0.00), (-0.02, 0.30), (0, 0.50), (0.05, 0.75), (0.12, 0.95), (0.25, 1.00)],
    },
    "market_cap_opportunity": {
        "weight": 15,
        "bands": [(1e9, 15), (3e9, 14), (10e9, 12), (30e9, 8), (100e9, 4), (None, 1)],
        "zero_if_revenue_growth_below": 0.0,
        "zero_if_revenue_below": 10e6,
        "warning_multiplier": 0.5,
        "revenue_fallback_periods": 4,
    },
    "competitive_advantage": {
        "weight": 10,
        "min_signals": 2,
        "stability_quarters": 8,
        "coverage_curve": [(0.50, 0.50), (0.75, 0.75), (1.00, 1.00)],
        "roic_spread": [(-0.10, 0.00), (0.00, 0.35), (0.05, 0.60), (0.15, 0.85), (0.30, 1.00)],
        "gm_stability": [(0.70, 0.00), (0.85, 0.35), (0.92, 0.65), (0.96, 0.90), (0.99, 1.00)],
        "gm_vs_industry": [(-0.20, 0.00), (-0.05, 0.30), (0.00, 0.50), (0.10, 0.80), (0.25, 1.00)],
        "rd_intensity": [(0.00, 0.00), (0.03, 0.25), (0.08, 0.55), (0.15, 0.85), (0.25, 1.00)],
    },
    "balance_sheet": {
        "weight": 5,
        "min_signals": 1,
        "coverage_curve": [(0.00, 0.00), (1.00, 1.00)],
        "blend": {"net_cash": 0.6, "leverage": 0.4},
        "net_cash_curve": [(-0.50, 0.00), (-0.20, 0.25), (0.00, 0.50), (0.10, 0.75), (0.25, 1.00)],
        "leverage_curve": [(0, 1.00), (1, 0.85), (2, 0.60), (4, 0.30), (6, 0.00)],
        "runway_curve": [(2, 0.00), (4, 0.20), (8, 0.50), (12, 0.80), (20, 1.00)],
    },
    "institutional_insider": {"weight": 5},
}

VALUATION = {
    "projection_years": 5,
    "terminal_growth_rate": 0.025,
    "max_implied_revenue_multiple": 3.00,
    "fade_curve": [(0, 1.00), (1, 0.80), (2, 0.60), (3, 0.40), (4, 0.20), (5, 0.00)],
    "mature_margin": {"lookback_periods": 8, "min_periods": 4, "max_dispersion": 1.00},
    "undervalued_max_ratio": 0.85,
    "overvalued_min_ratio": 1.15,
    "moat": {"lookback_periods": 8, "min_periods": 4, "persistent": 0.75, "intermittent": 0.40},
    "uncertainty": {
        "lookback_quarters": 8,
        "min_periods": 4,
        "coverage_curve": [(0.00, 0.00), (1.00, 1.00)],
        "revenue_curve": [(0.00, 0.00), (0.08, 0.20), (0.15, 0.45), (0.30, 0.75), (0.50, 1.00)],
        "margin_curve": [(0.00, 0.00), (0.02, 0.20), (0.05, 0.45), (0.10, 0.75), (0.20, 1.00)],
        "completeness_curve": [(0.00, 1.00), (0.50, 0.75), (0.70, 0.45), (0.85, 0.20), (1.00, 0.00)],
        "levels": {"moderate": 0.25, "elevated": 0.50, "severe": 0.75},
    },
}

RULE_VERSION = "score-1"
VALUATION_RULE_VERSION = "valuation-1"

FLOW_FIELDS = ["revenue", "gross_profit", "operating_income", "net_income", "ocf", "capex", "sbc", "rd_expense"]
PERIOD_FIELDS = ["revenue", "gross_profit", "operating_income", "net_income", "ocf", "capex", "fcf", "cash",
                 "total_debt", "equity", "shares_diluted", "shares_outstanding", "sbc", "rd_expense"]
CORE_FIELDS = ["revenue", "gross_profit", "operating_income", "fcf", "cash", "total_debt", "equity",
               "shares_diluted", "rd_expense", "sbc"]
DRIVER_BLOCKING_FIELDS = ["revenue", "operating_income", "total_debt"]
COMPLETENESS_FIELDS = [f for f in CORE_FIELDS if f not in DRIVER_BLOCKING_FIELDS]


def _check(curve):
    assert all(a[0] < b[0] for a, b in zip(curve, curve[1:])), curve


for _block in (*SCORING.values(), *VALUATION["uncertainty"].values(), VALUATION["fade_curve"]):
    for _name, _curve in (_block.items() if isinstance(_block, dict) else [("", _block)]):
        if isinstance(_curve, list) and _name != "bands":
            _check(_curve)
assert VALUATION["terminal_growth_rate"] < SCORING["wacc"]
