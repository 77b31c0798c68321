"""Generated by tools/decimal_outputs.py: decimal (money) output columns per query.

They leave the query as DOUBLE (cast after the exact decimal arithmetic) in both the
Spark result and its DuckDB twin, so the two compare equal however they are read."""

DECIMAL_OUTPUTS: dict[str, list[str]] = {
    'a1_revenue_by': ['total'],
    'a20_revenue_by_band': ['total'],
    'a20_revenue_by_month': ['total'],
    'a21_type_stats': ['total'],
    'a28_revenue_share': ['monto'],
    'a2_top_by_sum': ['total'],
    'a39_accounts_with_total': ['subtotal', 'iva', 'total'],
    'a3_global_stats': ['total'],
    'a8_open_account_totals': ['total_cuenta'],
    'b1_upsert': ['total'],
    'b2_discharges': ['total_cuenta'],
    'b3_register_studies': ['subtotal_total'],
    'j11_expand_orders_detail': ['subtotal'],
    'j11_expand_orders_header': ['subtotal_total'],
    'j4_reduce_matches': ['suma'],
    'j9_assemble': ['monto'],
    'm26_account_features': ['ingreso'],
    's3_conform': ['saldo'],
    's9_restore_tables': ['subtotal'],
    't15_iva': ['subtotal', 'iva', 'total'],
    'v10_budget_lines': ['subtotal', 'iva', 'total'],
    'v11_cash_cut': ['deposito', 'acumulado'],
    'v16_active_accounts': ['subtotal', 'iva', 'total'],
    'v22_open_attention_report': ['total_cuenta'],
    'v3_discharges': ['total_cuenta'],
    'v4_account_lines': ['subtotal', 'iva', 'total'],
    'w2_cash_cut': ['deposito', 'acumulado'],
}
