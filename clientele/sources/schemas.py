"""Columns of the source tables, as Spark DDL.

Types follow how the jobs use the columns; extra columns are ignored.
"""

SALES = """
region_key string, shop_code string, invoice_no string, item_code string,
sales_date timestamp_ntz, sold_qty double, net_amt_hkd decimal(18,4), net_amt decimal(18,4),
item_list_price decimal(18,4), shop_brand string, vip_no string, prod_brand string,
sale_lady_id string, cashier_id string, customer_nat string, cust_nat_cat string,
customer_sex string, customer_age_group string, void_flag string, valid_tx_flag int,
sales_staff_flag int, invoice_remark string, sales_type string
"""

MEMBERS = """
vip_no string, vip_main_no string, vip_type string, vip_issue_date date, vip_sex string,
vip_nation string, vip_agegrp string, region_key string, vip_staff_flag int,
vip_ba_first_pur_date date, vip_ba_vip_type string, vip_bp_first_pur_date date,
vip_bp_vip_type string
"""

CONTACTS = """
vip_main_no string, vip_opt_in int, vip_no_sms int, vip_no_phone int, vip_no_edm int,
vip_last_modified_date timestamp_ntz, vip_type_start_date date, vip_card_issue_date date,
vip_brand_code string, region_key string
"""

LOCATIONS = """
shop_code string, shop_desc string, city_district string, shop_brand string,
modified_date timestamp_ntz
"""

SKUS = """
item_code string, item_desc string, item_desc_c string, item_cat string,
item_sub_cat string, item_product_line string, item_product_line_desc string,
brand_code string, maincat_key string, retail_price_hk decimal(18,2),
retail_price_tw decimal(18,2), last_modified_date timestamp_ntz
"""

MAIN_CATEGORIES = "maincat_key string, maincat_code string, maincat_desc string"

SUBCATEGORIES = """
item_brand_key string, item_cat string, item_sub_cat string, item_subcat_desc string,
load_date timestamp_ntz
"""

FIRST_PURCHASES = "vip_main_no string, first_pur_ba date, first_pur_bp date"
