"""Schemas of the input tables."""

CELLS = (
    "doc_id long, sheet string, row long, col int, ctype string, text string,"
    " num double, num_fmt string")

UNIT_COLUMN_STRUCT = (
    "struct<unit_number:int,status:int,monthly_rent:int,market_rent:int,subsidy_rent:int,"
    "employee_discount:int,concession:int,tenant_name:int,tenant_name2:int,unit_sqft:int,"
    "unit_type:int,move_in_date:int,move_out_date:int,lease_start_date:int,lease_end_date:int>")

BLOCK_STRUCT = (
    "struct<charge_desc_col:int,charge_amt_col:int,rent_codes:array<string>,"
    "subsidy_codes:array<string>,discount_codes:array<string>,"
    "concession_codes:array<string>,reimbursed_codes:array<string>>")

STATED_SUMMARY_STRUCT = (
    "struct<total_monthly_rent:double,total_market_rent:double,total_sqft:double,"
    "occupancy_rate:double,occupied_units:double,vacant_units:double>")

STRUCTURES = (
    "doc_id long, sheet string, layout string, data_start_row long, header_row long,"
    f" columns {UNIT_COLUMN_STRUCT}, block {BLOCK_STRUCT},"
    " charge_columns array<struct<header:string,index:int,kind:string>>,"
    " charge_total_column int, skip_patterns array<string>, stop_markers array<string>,"
    f" stated_total_units long, stated_summary {STATED_SUMMARY_STRUCT},"
    " extra_columns array<struct<header:string,index:int>>")

RECORD = (
    "job_id string, file_name string, property_name string, status string,"
    " extracted_units long, stated_units long, uploaded_at timestamp, error string,"
    " total_tokens long, cost decimal(18,6), approved boolean")
