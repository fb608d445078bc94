"""DuckDB equivalents of the registered queries, written independently of them.

``CTES`` are named building blocks; an oracle names the blocks it needs and
``oracle`` puts them, with what they need in turn, in front.
"""

from __future__ import annotations

import re

from clientele.config import CUSTOMER_TAGS, ACTIVE_TAGS, PERSONA_NAMES
from verify.queries import CENTROIDS, CUTS, FEATURES, SPECS, STARTS
from verify.tables import VIEWS

CTES: dict[str, str] = {name: view.sql() for name, view in VIEWS.items()}
ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


def resolved(sql: str) -> str:
    """Prefix the blocks used, each after the blocks it uses itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in CTES and word not in order:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(sql)
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in order) + "\n" + sql


def text_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def day(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {col.split('.')[-1]}"


# -- sales mart -------------------------------------------------------------------

TEXT = ("region_key shop_code invoice_no item_code shop_brand vip_no prod_brand sale_lady_id "
        "cashier_id customer_nat cust_nat_cat customer_sex customer_age_group void_flag "
        "invoice_remark sales_type").split()


def projected(amount: str, trim: bool, cast: str = "") -> str:
    text = ", ".join(f"trim({c}) AS {c}" if trim else c for c in TEXT)
    money = ", ".join(f"CAST(CAST({c} AS {amount}) AS DOUBLE) AS {c}" if cast else f"CAST({c} AS {amount}) AS {c}"
                      for c in ("net_amt_hkd", "net_amt", "item_list_price"))
    key = "shop_code || '-' || invoice_no"
    date = "strftime(sales_date, '%Y-%m-%d')" if cast else "CAST(sales_date AS DATE)"
    return (f"SELECT {text}, {date} AS order_date, sold_qty, {money}, valid_tx_flag, sales_staff_flag, "
            f"{f'trim({key})' if trim else key} AS sales_main_key FROM sales")


MONEY_OUT = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("net_amt_hkd", "net_amt", "item_list_price"))
MONEY_COLS = "net_amt_hkd, net_amt, item_list_price"

CTES["typed_sales"] = projected("DECIMAL(18,4)", True)
CTES["key_map"] = "SELECT vip_no, min(vip_main_no) AS vip_main_no FROM members WHERE vip_main_no IS NOT NULL GROUP BY vip_no"
CTES["deduped"] = "SELECT DISTINCT * FROM typed_sales WHERE shop_brand IN ('BA', 'BP')"
CTES["history"] = "SELECT d.*, coalesce(m.vip_main_no, d.vip_no) AS vip_main_no FROM deduped d LEFT JOIN key_map m ON d.vip_no = m.vip_no"
CTES["windowed"] = "SELECT * FROM history WHERE order_date >= DATE '1996-01-01' AND order_date <= DATE '1998-12-31'"
CTES["sku_days"] = "SELECT DISTINCT * REPLACE (CAST(last_modified_date AS DATE) AS last_modified_date) FROM skus"
CTES["sku_latest"] = """SELECT s.* FROM sku_days s JOIN
 (SELECT item_code, max(last_modified_date) AS top FROM sku_days GROUP BY item_code) t
 ON s.item_code = t.item_code AND s.last_modified_date = t.top"""
CTES["sku_full"] = """SELECT s.*, c.maincat_code, c.maincat_desc FROM sku_latest s
 LEFT JOIN (SELECT DISTINCT maincat_key, maincat_code, maincat_desc FROM main_categories) c
 ON s.maincat_key = c.maincat_key"""
CTES["subcat_days"] = """SELECT DISTINCT item_brand_key, item_cat, item_sub_cat,
 CASE WHEN item_subcat_desc = 'FACE-CLEANSING' THEN 'FACE CLEANSING' ELSE item_subcat_desc END AS item_subcat_desc,
 load_date FROM subcategories"""
CTES["subcat_clean"] = """SELECT DISTINCT s.item_sub_cat, s.item_cat, s.item_brand_key, s.item_subcat_desc
 FROM subcat_days s JOIN (SELECT item_brand_key, item_sub_cat, max(load_date) AS top FROM subcat_days GROUP BY ALL) t
 ON s.item_brand_key = t.item_brand_key AND s.item_sub_cat = t.item_sub_cat AND s.load_date = t.top
 WHERE s.item_cat NOT IN ('BA13','BA12','BA11','BP10','BP11','BP12','BP13','BP14','BP15','BP88','BP99','ZZ','ZZZ','HB06','HB07','HB88')"""
CTES["shop_days"] = """SELECT DISTINCT shop_code, shop_desc, city_district, CAST(modified_date AS DATE) AS modified_date
 FROM locations WHERE shop_brand IN ('AU','BA','BP','BI','HB','JB')"""
CTES["shop_clean"] = """SELECT DISTINCT s.shop_code,
 CASE s.shop_code WHEN 'S1' THEN 'Flagship' WHEN 'S3' THEN 'Corner' ELSE s.shop_desc END AS shop_desc,
 CASE WHEN city_district LIKE '%TW-%' AND (city_district LIKE '%Hsinchu%' OR city_district LIKE '%Taipei%'
        OR city_district LIKE '%Taoyuan%' OR city_district LIKE '%Xinbei%') THEN 'Northern TW'
      WHEN city_district LIKE '%TW-%' AND city_district LIKE '%Taichung%' THEN 'Central TW'
      WHEN city_district LIKE '%TW-%' AND (city_district LIKE '%Kaohsiung%' OR city_district LIKE '%Tainan%') THEN 'Southern TW'
      ELSE 'Others' END AS sub_region
 FROM shop_days s JOIN (SELECT shop_code, max(modified_date) AS top FROM shop_days GROUP BY shop_code) t
 ON s.shop_code = t.shop_code AND s.modified_date = t.top"""
CTES["with_products"] = """SELECT DISTINCT a.*, b.item_desc, b.item_cat, b.item_sub_cat, b.brand_code, b.retail_price_hk,
 b.retail_price_tw, b.item_product_line_desc, b.maincat_desc, c.item_subcat_desc
 FROM windowed a
 LEFT JOIN sku_full b ON a.item_code = b.item_code AND a.prod_brand = b.brand_code
 LEFT JOIN subcat_clean c ON c.item_brand_key = a.shop_brand AND c.item_sub_cat = b.item_sub_cat AND c.item_cat = b.item_cat"""
CTES["enriched"] = """SELECT a.* EXCLUDE (vip_no), l.sub_region, l.shop_desc
 FROM with_products a LEFT JOIN shop_clean l ON a.shop_code = l.shop_code"""
CTES["net_lines"] = """SELECT e.* FROM enriched e JOIN
 (SELECT sales_main_key, sum(sold_qty) AS total FROM enriched GROUP BY sales_main_key) q
 ON e.sales_main_key = q.sales_main_key WHERE q.total <> 0"""
CTES["ba_store"] = """SELECT * FROM net_lines WHERE shop_brand = 'BA' AND retail_price_hk > 20
 AND item_cat NOT IN ('BA13','BA12','BA11') AND sales_staff_flag = 0 AND cashier_id = 'BAEXC'
 AND region_key IN ('HK','MO') AND sold_qty <> 0 AND valid_tx_flag = 1 AND void_flag IS NULL AND sales_type = 'Product'"""
CTES["ba_online"] = """SELECT * FROM net_lines WHERE shop_brand = 'BA' AND retail_price_hk > 20
 AND item_cat NOT IN ('BA13','BA12','BA11') AND sales_staff_flag = 0 AND shop_code = 'BAEHKG02'
 AND region_key IN ('HK','MO') AND sold_qty <> 0 AND valid_tx_flag = 1 AND void_flag IS NULL AND sales_type = 'Product'"""
CTES["bp_hk"] = """SELECT * FROM net_lines WHERE shop_brand = 'BP' AND retail_price_hk > 50 AND sold_qty <> 0 AND net_amt <> 0
 AND region_key IN ('HK','MO') AND cashier_id IN ('CASHIER','30241')
 AND item_cat NOT IN ('BP10','BP11','BP12','BP13','BP14','BP15','BP88','BP99','ZZ','ZZZ')
 AND sale_lady_id NOT IN ('sxd','BP888') AND valid_tx_flag = 1 AND void_flag IS NULL"""
CTES["bp_tw"] = """SELECT * FROM net_lines WHERE shop_brand = 'BP' AND retail_price_hk > 0 AND region_key = 'TW'
 AND cashier_id = 'CASHIER' AND item_cat NOT IN ('BP10','BP11','BP15','BP88','BP99','ZZ','ZZZ')
 AND sales_staff_flag = 0 AND sale_lady_id NOT IN ('sxd') AND sold_qty <> 0 AND valid_tx_flag = 1
 AND void_flag IS NULL AND net_amt_hkd > 0"""
CTES["ba_valid"] = "SELECT * FROM ba_store UNION SELECT * FROM ba_online"
CTES["ba_one_region"] = "SELECT * FROM ba_valid WHERE region_key = 'HK'"
CTES["bp_valid"] = "SELECT * FROM bp_hk UNION SELECT * FROM bp_tw"

DATED = f"* REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date, {MONEY_OUT}"
PRICES = ", CAST(retail_price_hk AS DOUBLE) AS retail_price_hk, CAST(retail_price_tw AS DOUBLE) AS retail_price_tw"

oracle("member_key_map", "SELECT vip_no, vip_main_no FROM key_map")
oracle("project_sales", projected("DECIMAL(10,0)", False, "out"))
oracle("trim_strings", f"SELECT {DATED}) FROM typed_sales")
oracle("dedup_sales", f"SELECT {DATED}) FROM deduped")
oracle("resolve_member", f"SELECT {DATED}) FROM history")
oracle("sales_window", f"SELECT {DATED}) FROM windowed")
oracle("latest_per_key", """SELECT user_id, event_id, strftime(day, '%Y-%m-%d') AS day, value FROM event_days e
 WHERE day = (SELECT max(day) FROM event_days x WHERE x.user_id = e.user_id)""")
oracle("latest_per_key_one", """SELECT user_id, event_id, strftime(day, '%Y-%m-%d') AS day, value FROM event_days
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC, event_id DESC) = 1""")
oracle("sub_region", "SELECT * FROM shop_clean")
oracle("clean_skus", f"SELECT * REPLACE (strftime(last_modified_date, '%Y-%m-%d') AS last_modified_date{PRICES}) FROM sku_latest")
oracle("enrich_sku", f"SELECT * REPLACE (strftime(last_modified_date, '%Y-%m-%d') AS last_modified_date{PRICES}) FROM sku_full")
oracle("clean_subcategories", "SELECT * FROM subcat_clean")
oracle("enrich_sales", f"SELECT {DATED}{PRICES}) FROM enriched")
oracle("net_zero_orders", f"SELECT {DATED}{PRICES}) FROM net_lines")
oracle("channel_rules", " UNION ALL ".join(
    f"SELECT '{label}' AS channel, sales_main_key, item_code, sold_qty, CAST(net_amt_hkd AS DOUBLE) AS net_amt_hkd FROM {cte}"
    for label, cte in (("BA store", "ba_store"), ("BA online", "ba_online"), ("BP hk", "bp_hk"), ("BP tw", "bp_tw"))))
oracle("channel_union", f"SELECT {DATED}{PRICES}) FROM ba_valid")
oracle("channel_union_second_brand", f"SELECT {DATED}{PRICES}) FROM bp_valid")
oracle("demographics", f"""SELECT DISTINCT vip_main_no, vip_type, {day('vip_issue_date')}, vip_sex, vip_nation,
 vip_agegrp, region_key, vip_staff_flag, {day('vip_ba_first_pur_date')}, vip_ba_vip_type
 FROM members WHERE vip_main_no IS NOT NULL""")
oracle("channel_union_one_brand", f"SELECT {DATED}{PRICES}) FROM ba_one_region")
oracle("demographics_second_brand", ORACLES["demographics"].replace("vip_ba_", "vip_bp_"))
oracle("first_purchase", """SELECT vip_main_no, shop_brand, strftime(min(order_date), '%Y-%m-%d') AS first_purchase
 FROM history GROUP BY vip_main_no, shop_brand""")
CTES["ba_history"] = """SELECT d.*, coalesce(m.vip_main_no, d.vip_no) AS vip_main_no
 FROM deduped d LEFT JOIN key_map m ON d.vip_no = m.vip_no WHERE shop_brand = 'BA'"""
oracle("first_last", """SELECT v.vip_main_no, strftime(f.first_day, '%Y-%m-%d') AS first_transaction_date,
 strftime(max(v.order_date), '%Y-%m-%d') AS last_transaction_date
 FROM ba_valid v LEFT JOIN (SELECT vip_main_no, min(order_date) AS first_day FROM ba_history GROUP BY vip_main_no) f
 ON v.vip_main_no = f.vip_main_no GROUP BY v.vip_main_no, f.first_day""")

oracle("first_last_given", ORACLES["first_last"].replace(
    "(SELECT vip_main_no, min(order_date) AS first_day FROM ba_history GROUP BY vip_main_no)",
    "(SELECT DISTINCT vip_main_no, vip_ba_first_pur_date AS first_day FROM members)"))

# -- value segments ---------------------------------------------------------------


def months(first: str, last: str) -> str:
    return (f"SELECT strftime(m, '%Y%m') AS yyyymm FROM (SELECT unnest(generate_series(DATE '{first}', "
            f"DATE '{last}', INTERVAL 1 MONTH)) AS m)")


def member_ctes(tag: str, first: str, p12m_first: str, last: str, bound: str) -> None:
    CTES[f"tx_{tag}"] = f"SELECT * FROM tx WHERE order_date BETWEEN DATE '{first}' AND DATE '{last}'"
    CTES[f"monthly_{tag}"] = f"""SELECT vip_main_no, strftime(order_date, '%Y%m') AS yyyymm, sum(net_amt_hkd) AS rev,
 count(DISTINCT invoice_no) AS tran_no FROM tx_{tag} GROUP BY ALL"""
    CTES[f"grid_{tag}"] = f"""SELECT m.vip_main_no, c.yyyymm, coalesce(r.rev, 0) AS monthly_clv
 FROM (SELECT DISTINCT vip_main_no FROM monthly_{tag}) m CROSS JOIN ({months(p12m_first, last)}) c
 LEFT JOIN monthly_{tag} r ON r.vip_main_no = m.vip_main_no AND r.yyyymm = c.yyyymm"""
    CTES[f"cumulative_{tag}"] = f"""SELECT *, sum(monthly_clv) OVER (PARTITION BY vip_main_no ORDER BY yyyymm) AS cumsum,
 row_number() OVER (PARTITION BY vip_main_no ORDER BY yyyymm) - 1 AS x FROM grid_{tag}"""
    CTES[f"points_{tag}"] = f"SELECT vip_main_no, x, CAST(cumsum AS DOUBLE) AS y FROM cumulative_{tag}"
    # 12 points have 66 slopes; middle pair averaged as written, without interpolation.
    CTES[f"slope_{tag}"] = f"""SELECT vip_main_no, (s[33] + s[34]) / 2.0 AS slope FROM (
 SELECT a.vip_main_no, list_sort(list((b.y - a.y) / CAST(b.x - a.x AS DOUBLE))) AS s
 FROM points_{tag} a JOIN points_{tag} b ON a.vip_main_no = b.vip_main_no AND a.x < b.x GROUP BY a.vip_main_no)"""
    CTES[f"line_{tag}"] = f"""SELECT s.vip_main_no, s.slope, (l[6] + l[7]) / 2.0 - s.slope * 5.5 AS intercept
 FROM slope_{tag} s JOIN (SELECT vip_main_no, list_sort(list(y)) AS l FROM points_{tag} GROUP BY vip_main_no) p
 ON s.vip_main_no = p.vip_main_no"""
    CTES[f"adjusted_{tag}"] = f"""SELECT *, CASE WHEN slope >= 0 AND intercept <> 0 THEN slope + abs(intercept) / 2
 ELSE slope END AS slope_final FROM line_{tag}"""
    CTES[f"firstlast_{tag}"] = f"""SELECT l.vip_main_no, f.first_transaction_date, l.last_transaction_date FROM
 (SELECT vip_main_no, max(order_date) AS last_transaction_date FROM tx_{tag} GROUP BY vip_main_no) l
 LEFT JOIN (SELECT vip_main_no, min(order_date) AS first_transaction_date FROM tx GROUP BY vip_main_no) f
 ON l.vip_main_no = f.vip_main_no"""
    CTES[f"status_{tag}"] = f"""SELECT *,
 round(date_diff('day', first_transaction_date, DATE '{last}') / 365.0::DOUBLE, 0) AS tenure,
 CASE WHEN first_transaction_date >= DATE '{p12m_first}' AND first_transaction_date <= DATE '{last}' THEN 'New Joiner'
      WHEN first_transaction_date < DATE '{p12m_first}' THEN 'old member' END AS new_joiner_flag,
 CASE WHEN last_transaction_date > DATE '{last}' - 730 AND last_transaction_date < DATE '{p12m_first}' THEN 'Inactive P12'
      WHEN last_transaction_date <= DATE '{last}' - 730 THEN 'Inactive P24' ELSE 'active_in_p12m' END AS inactive_flag
 FROM firstlast_{tag}"""
    CTES[f"total_{tag}"] = f"""SELECT s.*, t.total_clv,
 CASE WHEN tenure >= 3 THEN CAST(t.total_clv AS DOUBLE) / 3 WHEN tenure <> 0 THEN CAST(t.total_clv AS DOUBLE) / tenure END AS avg_annual_revenue
 FROM status_{tag} s JOIN (SELECT vip_main_no, sum(rev) AS total_clv FROM monthly_{tag} GROUP BY vip_main_no) t
 ON s.vip_main_no = t.vip_main_no WHERE new_joiner_flag IS NOT NULL"""
    CTES[f"recent_{tag}"] = f"""SELECT t.vip_main_no, t.new_joiner_flag, t.inactive_flag, t.last_transaction_date, sum(m.rev) AS p12m_clv
 FROM total_{tag} t JOIN monthly_{tag} m ON t.vip_main_no = m.vip_main_no
 WHERE CAST(m.yyyymm AS INT) > {bound} AND t.new_joiner_flag = 'old member' GROUP BY ALL"""
    CTES[f"bucket_{tag}"] = f"""SELECT vip_main_no, first_transaction_date, avg_annual_revenue, new_joiner_flag, inactive_flag, tenure,
 CASE WHEN avg_annual_revenue > {CUTS.clv_high} THEN 'H'
      WHEN avg_annual_revenue >= {CUTS.clv_low} AND avg_annual_revenue <= {CUTS.clv_high} THEN 'M' ELSE 'L' END AS flag_total_clv
 FROM total_{tag} WHERE new_joiner_flag = 'old member' AND inactive_flag = 'active_in_p12m'"""
    CTES[f"flagged_{tag}"] = f"""SELECT *, CASE WHEN slope_final > {CUTS.slope_high} THEN 'H'
 WHEN slope_final >= {CUTS.slope_low} AND slope_final <= {CUTS.slope_high} THEN 'M' ELSE 'L' END AS slope_flag FROM adjusted_{tag}
 WHERE vip_main_no IN (SELECT vip_main_no FROM recent_{tag})"""
    # One row per cell of the rule table.
    e, g = CUTS.engaged, CUTS.emerging
    CTES[f"segment_{tag}"] = f"""SELECT vip_main_no, first_transaction_date, avg_annual_revenue, new_joiner_flag, inactive_flag,
 p12m_clv, tenure,
 CASE coalesce(c, '-') || t
   WHEN 'LH' THEN 'Low Value' WHEN 'LM' THEN 'Low Value' WHEN 'LL' THEN 'Low Value'
   WHEN 'HL' THEN 'At Risk' WHEN 'ML' THEN 'At Risk'
   WHEN 'HH' THEN CASE WHEN p >= {e} THEN 'Engaged' WHEN p >= {g} THEN 'Emerging' WHEN p < {g} THEN 'At Risk' ELSE '' END
   WHEN 'HM' THEN CASE WHEN p >= {e} THEN 'Engaged' WHEN p >= {g} THEN 'Emerging' WHEN p < {g} THEN 'At Risk' ELSE '' END
   WHEN 'MH' THEN CASE WHEN p > {g} THEN 'Emerging' ELSE 'At Risk' END
   WHEN 'MM' THEN CASE WHEN p > {g} THEN 'Emerging' WHEN p <= {g} THEN 'At Risk' ELSE '' END
   ELSE '' END AS value_segment
 FROM (SELECT f.vip_main_no, b.* EXCLUDE (vip_main_no), r.p12m_clv, b.flag_total_clv AS c, f.slope_flag AS t, r.p12m_clv AS p
 FROM flagged_{tag} f LEFT JOIN bucket_{tag} b ON f.vip_main_no = b.vip_main_no
 LEFT JOIN recent_{tag} r ON f.vip_main_no = r.vip_main_no)"""
    CTES[f"tags_{tag}"] = f"""SELECT t.*, s.p12m_clv, s.value_segment,
 CASE WHEN t.new_joiner_flag = 'New Joiner' THEN 'New Joiner' WHEN t.inactive_flag = 'Inactive P24' THEN 'Inactive P24'
      WHEN t.inactive_flag = 'Inactive P12' THEN 'Inactive P12' ELSE s.value_segment END AS customer_tag
 FROM total_{tag} t LEFT JOIN segment_{tag} s ON t.vip_main_no = s.vip_main_no"""


member_ctes("this", "1998-08-01", "2000-08-01", "2001-07-31", "200007")
member_ctes("last", "1997-08-01", "1999-08-01", "2000-07-31", "199907")
member_ctes("past", "1994-08-01", "1996-08-01", "1997-07-31", "199607")

oracle("month_calendar", """SELECT DISTINCT strftime(d, '%Y%m') AS yyyymm FROM
 (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS d
  FROM (SELECT min(order_date) AS lo, max(order_date) AS hi FROM tx))""")
oracle("monthly_revenue", """SELECT vip_main_no, strftime(order_date, '%Y%m') AS yyyymm,
 CAST(sum(net_amt_hkd) AS DOUBLE) AS rev, count(DISTINCT invoice_no) AS tran_no FROM tx GROUP BY ALL""")
oracle("monthly_revenue_region", """SELECT vip_main_no, strftime(order_date, '%Y%m') AS yyyymm,
 CAST(sum(net_amt_hkd) AS DOUBLE) AS rev, count(DISTINCT invoice_no) AS tran_no
 FROM tx_shop WHERE region_key = 'ASIA' GROUP BY ALL""")
oracle("month_grid", "SELECT vip_main_no, yyyymm, CAST(monthly_clv AS DOUBLE) AS monthly_clv FROM grid_this")
oracle("cumulative_spend", """SELECT vip_main_no, yyyymm, CAST(monthly_clv AS DOUBLE) AS monthly_clv,
 CAST(cumsum AS DOUBLE) AS cumsum FROM cumulative_this""")
oracle("spend_series", "SELECT vip_main_no, x AS pos, y AS col FROM points_this")
oracle("theil_sen", "SELECT vip_main_no, slope, intercept FROM line_this")
# 36 points have 630 slopes.
CTES["grid_mart"] = f"""SELECT m.vip_main_no, c.yyyymm, coalesce(r.rev, 0) AS monthly_clv
 FROM (SELECT DISTINCT vip_main_no FROM monthly_this) m CROSS JOIN ({months('1998-08-01', '2001-07-31')}) c
 LEFT JOIN monthly_this r ON r.vip_main_no = m.vip_main_no AND r.yyyymm = c.yyyymm"""
CTES["points_mart"] = """SELECT vip_main_no, row_number() OVER w - 1 AS x, CAST(sum(monthly_clv) OVER w AS DOUBLE) AS y FROM grid_mart
 WINDOW w AS (PARTITION BY vip_main_no ORDER BY yyyymm)"""
oracle("theil_sen_mart", """SELECT s.vip_main_no, slope, (l[18] + l[19]) / 2.0 - slope * 17.5 AS intercept FROM (
 SELECT vip_main_no, (s[315] + s[316]) / 2.0 AS slope FROM (SELECT a.vip_main_no, list_sort(list((b.y - a.y) / CAST(b.x - a.x AS DOUBLE))) AS s
 FROM points_mart a JOIN points_mart b ON a.vip_main_no = b.vip_main_no AND a.x < b.x GROUP BY a.vip_main_no)) s
 JOIN (SELECT vip_main_no, list_sort(list(y)) AS l FROM points_mart GROUP BY vip_main_no) p ON s.vip_main_no = p.vip_main_no""")
oracle("adjust_slope", "SELECT vip_main_no, slope, intercept, slope_final FROM adjusted_this")
oracle("trend_bucket", f"""SELECT CASE WHEN slope_final > {CUTS.slope_high} THEN 'H' WHEN slope_final >= {CUTS.slope_low} THEN 'M'
 ELSE 'L' END AS slope_flag, count(*) AS members, min(slope_final) AS lowest, max(slope_final) AS highest
 FROM adjusted_this GROUP BY 1""")
STATUS_OUT = f"{day('first_transaction_date')}, {day('last_transaction_date')}, tenure, new_joiner_flag, inactive_flag"
TOTAL_OUT = f"vip_main_no, {STATUS_OUT}, CAST(total_clv AS DOUBLE) AS total_clv, avg_annual_revenue"
SEGMENT_OUT = f"""vip_main_no, {day('first_transaction_date')}, avg_annual_revenue, new_joiner_flag, inactive_flag,
 CAST(p12m_clv AS DOUBLE) AS p12m_clv, tenure"""
oracle("member_status", f"SELECT vip_main_no, {STATUS_OUT} FROM status_past")
oracle("total_clv", f"SELECT {TOTAL_OUT} FROM total_past")
oracle("p12m_clv", f"""SELECT vip_main_no, new_joiner_flag, inactive_flag, {day('last_transaction_date')},
 CAST(p12m_clv AS DOUBLE) AS p12m_clv FROM recent_this""")
oracle("clv_bucket", f"""SELECT vip_main_no, {day('first_transaction_date')}, avg_annual_revenue, new_joiner_flag,
 inactive_flag, tenure, flag_total_clv FROM bucket_this""")
oracle("value_segment", f"SELECT {SEGMENT_OUT}, value_segment FROM segment_this")
oracle("value_segment_one_pass", ORACLES["value_segment"])
oracle("segment_summary", """SELECT value_segment, CAST(max(p12m_clv) AS DOUBLE) AS max_p12m_clv,
 CAST(min(p12m_clv) AS DOUBLE) AS min_p12m_clv, max(avg_annual_revenue) AS max_avg_annual_revenue,
 min(avg_annual_revenue) AS min_avg_annual_revenue, round(avg(avg_annual_revenue), 4) AS avg_avg_annual_revenue,
 round(CAST(sum(p12m_clv) AS DOUBLE) / count(p12m_clv), 4) AS avg_p12m_clv, count(DISTINCT vip_main_no) AS members
 FROM segment_this GROUP BY value_segment""")
oracle("calibrate", "SELECT measure, prob, cutoff FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, CAST({p} AS DOUBLE) AS prob, quantile_disc({expr}, {p}) AS cutoff FROM {src}"
    for m, expr, src in (
        ("slope_final", "slope_final", "flagged_this"),
        ("avg_annual_revenue", "t.avg_annual_revenue", "total_this t JOIN recent_this r ON t.vip_main_no = r.vip_main_no"),
        ("p12m_clv", "CAST(p12m_clv AS DOUBLE)", "recent_this"))
    for p in (0.5, 0.7, 0.75, 0.9)) + ")")
oracle("inactive_members", f"SELECT {TOTAL_OUT} FROM total_past WHERE inactive_flag = 'Inactive P24'")
oracle("reclassify", f"""SELECT {SEGMENT_OUT.replace('vip_main_no', 't.vip_main_no').replace("strftime(first", "strftime(t.first")
 .replace(' avg_annual_revenue,', ' t.avg_annual_revenue,').replace(' new_joiner_flag', ' t.new_joiner_flag')
 .replace(' inactive_flag', ' t.inactive_flag').replace('CAST(p12m_clv', 'CAST(t.p12m_clv').replace(', tenure', ', t.tenure')},
 CASE t.value_segment || '/' || coalesce(l.value_segment, 'none') WHEN 'Emerging/Engaged' THEN 'At Risk'
 WHEN 'At Risk/Low Value' THEN 'Low Value' ELSE t.value_segment END AS value_segment
 FROM segment_this t LEFT JOIN segment_last l ON t.vip_main_no = l.vip_main_no""")

# -- segment reports --------------------------------------------------------------

CTES["compared"] = """SELECT t.vip_main_no, t.customer_tag, coalesce(l.customer_tag, 'Inactive P24') AS customer_tag_last_year
 FROM tags_this t LEFT JOIN tags_last l ON t.vip_main_no = l.vip_main_no"""
WINDOWED = "order_date BETWEEN DATE '2000-08-01' AND DATE '2001-07-31'"
for suffix in ("", "_item", "_shop"):
    CTES[f"tagged{suffix}"] = (f"SELECT g.*, x.* EXCLUDE (vip_main_no) FROM tags_this g "
                               f"LEFT JOIN tx{suffix} x ON g.vip_main_no = x.vip_main_no")


def pivot(by: str, cell: str, source: str, tags=CUSTOMER_TAGS, where: str = "TRUE", name: str | None = None) -> str:
    """Aggregate per tag with FILTER; NULL where a tag has no rows in the group."""
    name = name or by
    cells = ", ".join(
        f"""{cell} FILTER (WHERE customer_tag = '{t}') AS "{t}" """ for t in tags)
    return f"SELECT {by} AS {name}, {cells} FROM {source} WHERE {where} GROUP BY 1"


def count_cells(by: str, key: str, source: str, tags=CUSTOMER_TAGS, where: str = "TRUE", name: str | None = None) -> str:
    """Distinct counts: a group without rows of a tag is NULL, not 0."""
    name = name or by
    cells = ", ".join(
        f"""CASE WHEN count(*) FILTER (WHERE customer_tag = '{t}') > 0
 THEN count(DISTINCT {key}) FILTER (WHERE customer_tag = '{t}') END AS "{t}" """ for t in tags)
    return f"SELECT {by} AS {name}, {cells} FROM {source} WHERE {where} GROUP BY 1"


MONEY_SUM = "CAST(sum(net_amt_hkd)"


def money_pivot(by: str, source: str, tags=CUSTOMER_TAGS, where: str = "TRUE", name: str | None = None) -> str:
    name = name or by
    cells = ", ".join(f"""CAST(sum(net_amt_hkd) FILTER (WHERE customer_tag = '{t}') AS DOUBLE) AS "{t}" """ for t in tags)
    return f"SELECT {by} AS {name}, {cells} FROM {source} WHERE {where} GROUP BY 1"


oracle("customer_tag", f"""SELECT {TOTAL_OUT}, CAST(p12m_clv AS DOUBLE) AS p12m_clv, value_segment, customer_tag FROM tags_past""")
oracle("compare_years", "SELECT vip_main_no, customer_tag, customer_tag_last_year FROM compared")
oracle("migration_matrix", count_cells("customer_tag_last_year", "vip_main_no", "compared"))
oracle("tagged_members", """SELECT g.vip_main_no, g.customer_tag, m.vip_type, m.vip_sex, m.vip_agegrp FROM tags_this g
 LEFT JOIN (SELECT DISTINCT vip_no, vip_type, vip_sex, vip_agegrp FROM members) m ON g.vip_main_no = m.vip_no""")
oracle("tagged_sales", f"""SELECT g.vip_main_no, g.customer_tag, x.invoice_no, x.shop_code, CAST(x.net_amt_hkd AS DOUBLE) AS net_amt_hkd,
 x.sold_qty FROM tags_this g LEFT JOIN (SELECT * FROM tx WHERE {WINDOWED}) x ON g.vip_main_no = x.vip_main_no""")
oracle("sum_pivot", money_pivot("region_key", "tagged_shop"))
oracle("count_pivot", count_cells("region_key", "invoice_no", "tagged_shop"))
CTES["region_n"] = "SELECT customer_tag, region_key, count(DISTINCT vip_main_no) AS n FROM tagged_shop GROUP BY ALL"
CTES["region_share"] = """SELECT a.customer_tag, a.region_key, round(CAST(a.n AS DOUBLE) / b.total * 100, 2) AS share FROM region_n a
 JOIN (SELECT customer_tag, sum(n) AS total FROM region_n GROUP BY 1) b ON a.customer_tag IS NOT DISTINCT FROM b.customer_tag"""
oracle("percent_pivot", pivot("region_key", "max(share)", "region_share"))
CTES["member_sex"] = """SELECT vip_main_no, customer_tag, min(coalesce(customer_sex, 'C')) AS sex FROM tagged GROUP BY 1, 2"""
oracle("gender_profile", count_cells("sex", "vip_main_no", "member_sex"))
BAND = "CASE WHEN tenure <= 1 THEN '0-1' WHEN tenure > 1 AND tenure <= 3 THEN '1-3' WHEN tenure > 3 AND tenure <= 7 THEN '3-7' ELSE '8+' END"
oracle("tenure_profile", count_cells(BAND, "vip_main_no", "tags_this", name="tenure_band"))
for name, listed in (("nationality_profile", "'Hong Kong','Mainland China','Macau'"),
                     ("nationality_profile_four", "'Hong Kong','Mainland China','Macau','Taiwanese'")):
    oracle(name, count_cells("nationality", "vip_main_no", f"""(SELECT vip_main_no, customer_tag,
 min(CASE WHEN cust_nat_cat IN ({listed}) THEN cust_nat_cat ELSE 'Others' END) AS nationality FROM tagged GROUP BY 1, 2)"""))
oracle("region_profile", count_cells("region_key", "vip_main_no",
       "(SELECT vip_main_no, customer_tag, min(region_key) AS region_key FROM tagged_shop GROUP BY 1, 2)"))
oracle("region_profile_every", count_cells("region_key", "vip_main_no", "tagged_shop"))
for name, agg in (("age_profile", "max"), ("age_profile_min", "min")):
    oracle(name, count_cells("age", "vip_main_no", f"""(SELECT vip_main_no, customer_tag, CASE {agg}(customer_age_group)
 WHEN '01' THEN '< 25' WHEN '02' THEN '26 - 30' WHEN '03' THEN '31 - 35' WHEN '04' THEN '36 - 40'
 WHEN '05' THEN '41 - 50' WHEN '06' THEN '> 51' END AS age FROM tagged GROUP BY vip_main_no, customer_tag)"""))
oracle("tag_counts", "SELECT customer_tag, count(DISTINCT vip_main_no) AS members FROM tags_this GROUP BY customer_tag")


def kpis(source: str, tags) -> str:
    parts = []
    for kpi, cell in (("amount", "CAST(sum(net_amt_hkd) {f} AS DOUBLE)"), ("quantity", "CAST(sum(sold_qty) {f} AS DOUBLE)"),
                      ("orders", "CAST(nullif(count(DISTINCT invoice_no) {f}, 0) AS DOUBLE)")):
        cells = ", ".join(cell.format(f=f"FILTER (WHERE customer_tag = '{t}')") + f' AS "{t}"' for t in tags)
        parts.append(f"SELECT '{kpi}' AS kpi, {cells} FROM {source} WHERE {WINDOWED}")
    return " UNION ALL ".join(parts)


oracle("sales_kpis", kpis("tagged", ACTIVE_TAGS))
CTES["visit_days"] = f"""SELECT vip_main_no, customer_tag, order_date, shop_code,
 CASE WHEN shop_code IS NULL THEN 0 ELSE 1 END AS visit FROM (SELECT DISTINCT vip_main_no, customer_tag, order_date, shop_code
 FROM tagged WHERE {WINDOWED})"""
oracle("visits", pivot("'visits'", "sum(visit)", "visit_days", ACTIVE_TAGS, name="measure"))
LINE = "CASE WHEN item_product_line_desc IS NULL OR item_product_line_desc = 'N/A' THEN 'Unknown' ELSE item_product_line_desc END"
SUB = "CASE WHEN item_subcat_desc IS NULL OR item_subcat_desc = 'N/A' THEN 'Unknown' ELSE item_subcat_desc END"
oracle("category_pivot", money_pivot(LINE, "tagged_item", where=WINDOWED, name="item_product_line_desc"))
oracle("category_quantity", pivot("item_subcat_desc", "sum(sold_qty)", "tagged_item", where=WINDOWED))
oracle("category_buyers_pivot", count_cells(LINE, "vip_main_no", "tagged_item", where=WINDOWED, name="item_product_line_desc"))
oracle("category_buyers", f"""SELECT {SUB} AS item_subcat_desc, customer_tag, count(DISTINCT vip_main_no) AS members
 FROM tagged_item WHERE {WINDOWED} GROUP BY 1, 2""")
oracle("store_penetration", count_cells("shop_desc", "vip_main_no", "tagged_shop", where=WINDOWED))
oracle("month_penetration", count_cells("strftime(order_date, '%Y%m')", "vip_main_no", "tagged", name="yyyymm"))
def unpivoted(report: str, sql: str, label: str, tags=CUSTOMER_TAGS) -> str:
    return " UNION ALL ".join(f"""SELECT '{report}' AS report, CAST({label} AS VARCHAR) AS label, '{t}' AS tag,
 CAST("{t}" AS DOUBLE) AS value FROM ({sql})""" for t in tags)


_QUANTITY = pivot(LINE, "sum(sold_qty)", "tagged_item", where=WINDOWED, name="item_product_line_desc")
oracle("segment_reports", " UNION ALL ".join([
    *[unpivoted(report, ORACLES[name], label) for report, name, label in (
        ("gender", "gender_profile", "sex"), ("nationality", "nationality_profile", "nationality"), ("region", "region_profile", "region_key"),
        ("age", "age_profile", "age"), ("category_amount", "category_pivot", "item_product_line_desc"),
        ("category_buyers", "category_buyers_pivot", "item_product_line_desc"), ("stores", "store_penetration", "shop_desc"),
        ("months", "month_penetration", "yyyymm"))],
    unpivoted("category_quantity", _QUANTITY, "item_product_line_desc"),
    unpivoted("kpis", ORACLES["sales_kpis"], "kpi", ACTIVE_TAGS), unpivoted("visits", ORACLES["visits"], "measure", ACTIVE_TAGS)]))
oracle("buyer_bitmaps", " UNION ALL ".join(f"""SELECT '{dimension}' AS dimension, {label} AS label, customer_tag, count(DISTINCT vip_main_no) AS members
 FROM {source} WHERE {where} AND order_date IS NOT NULL GROUP BY 1, 2, 3""" for dimension, label, source, where in (
    ("month", "strftime(order_date, '%Y%m')", "tagged", "TRUE"),
    ("quarter", "strftime(order_date, '%Y') || 'Q' || CAST(quarter(order_date) AS VARCHAR)", "tagged", "TRUE"),
    ("store", "shop_desc", "tagged_shop", WINDOWED), ("category", LINE, "tagged_item", WINDOWED))))
oracle("attribute_conflicts", """SELECT vip_main_no, count(DISTINCT coalesce(customer_sex, 'C')) AS n_values
 FROM tx GROUP BY vip_main_no HAVING count(DISTINCT coalesce(customer_sex, 'C')) > 1""")
oracle("distinct_values", "SELECT DISTINCT item_product_line_desc FROM tx_item")
oracle("min_date", "SELECT strftime(min(order_date), '%Y-%m-%d') AS min_order_date FROM tx_shop WHERE region_key = 'ASIA'")
oracle("reconcile_count", f"SELECT count(DISTINCT vip_main_no) AS members FROM tx WHERE {WINDOWED} AND sales_staff_flag = 0")

# -- personas ---------------------------------------------------------------------

CTES["feature_lines"] = """SELECT * FROM tx_item WHERE vip_main_no IS NOT NULL AND vip_main_no <> '' AND prod_brand IS NOT NULL AND prod_brand NOT IN ('JBZZZ','ZZ')
 AND item_subcat_desc IS NOT NULL AND item_subcat_desc NOT IN ('ZZZ','Dummy','dummy')
 AND maincat_desc IS NOT NULL AND maincat_desc NOT IN ('ZZZ','Dummy','dummy')"""


def share(by: str, values, total: str = "sum(net_amt_hkd)") -> str:
    part = f"coalesce(sum(net_amt_hkd) FILTER (WHERE {by} IN ({text_list(values)})), 0)"
    return f"CAST({part} AS DOUBLE) / nullif(CAST({total} AS DOUBLE), 0) * 100"


SHARES = {f"{n}{s.suffix}": share(s.by, v) for s in SPECS for n, v in s.groups.items()}
CTES["shares"] = ("SELECT vip_main_no, " + ", ".join(f'{e} AS "{n}"' for n, e in SHARES.items())
                  + " FROM feature_lines GROUP BY vip_main_no")
CTES["filled"] = "SELECT vip_main_no, " + ", ".join(f'coalesce("{n}", 0) AS "{n}"' for n in FEATURES) + " FROM shares"


def rounded(cols) -> str:
    return ", ".join(f'round("{c}", 6) AS "{c}"' for c in cols)


oracle("clean_for_features", """SELECT vip_main_no, invoice_no, item_code, prod_brand, item_subcat_desc, maincat_desc,
 CAST(net_amt_hkd AS DOUBLE) AS net_amt_hkd FROM feature_lines""")
oracle("collect_by_member", """SELECT vip_main_no, item_subcat_desc AS value, count(*) AS times FROM feature_lines GROUP BY 1, 2""")
oracle("demographic_features", """SELECT l.vip_main_no,
 min(CASE WHEN customer_sex IS NULL OR customer_sex IN ('', 'C') THEN 'C' ELSE customer_sex END) AS customer_sex,
 min(CASE WHEN cust_nat_cat IN ('Hong Kong','Mainland China','Macau') THEN cust_nat_cat ELSE 'Others' END) AS cust_nat_cat,
 CASE WHEN years <= 1 THEN '0-1' WHEN years <= 3 THEN '1-3' WHEN years <= 7 THEN '3-7' ELSE '8+' END AS tenure,
 CASE max(CASE WHEN customer_age_group BETWEEN '01' AND '06' THEN customer_age_group END)
  WHEN '01' THEN '< 25' WHEN '02' THEN '26 - 30' WHEN '03' THEN '31 - 35' WHEN '04' THEN '36 - 40'
  WHEN '05' THEN '41 - 50' WHEN '06' THEN '> 51' END AS age
 FROM feature_lines l LEFT JOIN (SELECT vip_main_no, round(date_diff('day', first_transaction_date, DATE '2001-08-01') / 365.0::DOUBLE, 0) AS years
 FROM firstlast_this) f ON l.vip_main_no = f.vip_main_no GROUP BY 1, 4""")
oracle("member_totals", """SELECT vip_main_no, CAST(sum(net_amt_hkd) AS DOUBLE) AS net_amt_hkd, sum(sold_qty) AS sold_qty,
 count(DISTINCT invoice_no) AS invoice_no FROM feature_lines GROUP BY vip_main_no""")
oracle("share_of_wallet", "SELECT vip_main_no, " + rounded(FEATURES[:3]) + " FROM shares")
oracle("group_features", "SELECT vip_main_no, " + rounded(FEATURES[5:]) + " FROM shares")
oracle("wallet_features", "SELECT vip_main_no, " + rounded(FEATURES) + " FROM shares")
oracle("feature_matrix", "SELECT f.vip_main_no, " + rounded(FEATURES)
       + ", CASE WHEN p.persona BETWEEN 0 AND 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS tagged FROM filled f "
         "LEFT JOIN personas p ON f.vip_main_no = p.vip_main_no")
oracle("zero_share", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CASE WHEN "{c}" = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share FROM filled"""
    for c in FEATURES))
oracle("drop_zero_columns", "SELECT vip_main_no, "
       + rounded([c for c in FEATURES if c not in ("Pair_by_line", "None_by_line")])
       + " FROM filled WHERE vip_main_no NOT IN ('17', '42')")
oracle("standardize", "SELECT vip_main_no, " + ", ".join(
    f"""round(CASE WHEN s."{c}" > 0 THEN (f."{c}" - m."{c}") / s."{c}" ELSE 0 END, 6) AS "{c}" """ for c in FEATURES)
       + " FROM filled f CROSS JOIN (SELECT " + ", ".join(f'avg("{c}") AS "{c}"' for c in FEATURES)
       + " FROM filled) m CROSS JOIN (SELECT " + ", ".join(f'stddev_pop("{c}") AS "{c}"' for c in FEATURES) + " FROM filled) s")
oracle("nearest_centroid", "SELECT vip_main_no, CAST(arg_min(k, d) AS INT) AS persona FROM (" + " UNION ALL ".join(
    f"SELECT vip_main_no, {i} AS k, " + " + ".join(f'("{c}" - {float(x)}::DOUBLE) * ("{c}" - {float(x)}::DOUBLE)' for c, x in zip(FEATURES, centre))
    + " AS d FROM filled" for i, centre in enumerate(CENTROIDS)) + ") GROUP BY vip_main_no")
oracle("single_cluster_cost", "SELECT round(" + " + ".join(f'var_pop("{c}") * count("{c}")' for c in FEATURES) + ", 2) AS wcss FROM filled")
oracle("kmeans_sweep", """SELECT CAST(k AS INT) AS k, round(CAST(varying * members AS DOUBLE), 2) AS wcss_of_one, true AS bounded,
 true AS cost_agrees, true AS settled
 FROM range(1, 21) r(k) CROSS JOIN (SELECT count(*) AS members, """ + " + ".join(
    f'CASE WHEN stddev_pop("{c}") > 0 THEN 1 ELSE 0 END' for c in FEATURES) + " AS varying FROM filled)")
oracle("kmeans_fit", "SELECT count(*) AS members, 0 AS away, true AS cost_agrees FROM filled")
oracle("saved_model_scoring", "SELECT count(*) AS members, 0 AS differing, 0 AS away FROM filled")
oracle("one_pass_moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg(CASE WHEN "{c}" = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_share,
 round(avg("{c}"), 6) AS mean, round(stddev_pop("{c}"), 6) AS std FROM filled""" for c in FEATURES))
oracle("factor_weights", " UNION ALL ".join(f"""SELECT '{c}' AS feature, CASE WHEN stddev_pop("{c}") > 0 THEN 1.0::DOUBLE ELSE 0 END AS variance,
 0 AS gaps, true AS weighed FROM filled""" for c in FEATURES))

# Rounds of k-means, each a block over the one before.
CTES["scaled"] = ORACLES["standardize"].replace("round(CASE", "(CASE").replace("END, 6)", "END)")
CTES["centres_0"] = " UNION ALL ".join(f"SELECT {k} AS k, {i} AS persona, " + ", ".join(f'{x}::DOUBLE AS "{c}"' for c, x in zip(FEATURES, STARTS[i]))
                                       for k in (3, 5) for i in range(k))
for step in range(5):
    square = " + ".join(f'(s."{c}" - m."{c}") * (s."{c}" - m."{c}")' for c in FEATURES)
    CTES[f"placed_{step}"] = f"""SELECT s.*, m.k, m.persona FROM scaled s CROSS JOIN centres_{step} m
 QUALIFY row_number() OVER (PARTITION BY s.vip_main_no, m.k ORDER BY {square}, m.persona) = 1"""
    CTES[f"centres_{step + 1}"] = "SELECT m.k, m.persona, " + ", ".join(f'coalesce(avg(p."{c}"), any_value(m."{c}")) AS "{c}"' for c in FEATURES) + f"""
 FROM centres_{step} m LEFT JOIN placed_{step} p ON p.k = m.k AND p.persona = m.persona GROUP BY 1, 2"""
oracle("kmeans_steps", " UNION ALL ".join(f"""SELECT k, persona, '{c}' AS feature, round("{c}", 6) AS centre,
 (SELECT count(*) FROM placed_4 p WHERE p.k = m.k AND p.persona = m.persona) AS members FROM centres_4 m""" for c in FEATURES))
oracle("feature_correlation", " UNION ALL ".join(
    f"""SELECT '{a}' AS feature, '{b}' AS other, round(CASE WHEN stddev_pop("{a}") > 0 AND stddev_pop("{b}") > 0
 THEN corr("{a}", "{b}") ELSE 0 END, 5) AS correlation FROM filled""" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
NAME = "CASE persona " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in PERSONA_NAMES.items()) + " END"
CTES["named"] = f"SELECT vip_main_no, {NAME} AS persona FROM personas"
CTES["preferred"] = """SELECT vip_main_no, vip_opt_in, vip_no_sms, vip_no_phone, vip_no_edm FROM contacts
 WHERE vip_brand_code = 'BA' AND region_key = 'HK'
 QUALIFY row_number() OVER (PARTITION BY vip_main_no ORDER BY vip_last_modified_date DESC NULLS FIRST,
 vip_type_start_date DESC NULLS LAST, vip_card_issue_date DESC NULLS LAST, vip_opt_in DESC NULLS LAST,
 vip_no_sms DESC NULLS LAST, vip_no_phone DESC NULLS LAST, vip_no_edm DESC NULLS LAST) = 1"""
oracle("name_personas", "SELECT vip_main_no, persona FROM named")
oracle("latest_preferences", "SELECT * FROM preferred")
oracle("contact_list", """SELECT '2001-08-01' AS date_of_run, n.vip_main_no, n.persona, p.vip_opt_in, p.vip_no_sms, p.vip_no_phone, p.vip_no_edm
 FROM named n LEFT JOIN preferred p ON n.vip_main_no = p.vip_main_no""")
oracle("persona_counts", """SELECT persona, count(*) AS count, count(DISTINCT vip_main_no) AS no_of_vip, 0 AS is_total FROM named GROUP BY persona
 UNION ALL SELECT NULL, count(*), count(DISTINCT vip_main_no), 1 FROM named""")
oracle("persona_counts_wide", "SELECT 'no. of customer' AS Persona, " + ", ".join(
    f"CAST(nullif(count(*) FILTER (WHERE persona = '{n}'), 0) AS BIGINT) AS {n.replace(' ', '_')}" for n in PERSONA_NAMES.values())
       + ", count(*) AS Total FROM named")
CTES["report_lines"] = """SELECT *, maincat_desc_cleaned || ' - ' || item_subcat_desc_cleaned AS maincat_and_subcat FROM (SELECT *,
 CASE maincat_desc WHEN 'gift' THEN 'GIFT' WHEN 'ZZ' THEN 'Unknown' WHEN 'Dummy' THEN 'Unknown' ELSE maincat_desc END AS maincat_desc_cleaned,
 CASE WHEN item_subcat_desc IN ('ZZZ', 'dummy', 'Dummy') THEN 'Unknown' WHEN item_subcat_desc = 'gift' THEN 'GIFT' ELSE item_subcat_desc END AS item_subcat_desc_cleaned
 FROM tx_item) WHERE prod_brand = 'BA' AND maincat_desc_cleaned NOT IN ('Unknown') AND sales_staff_flag = 0"""
CTES["persona_lines"] = "SELECT l.*, n.persona, n.persona AS customer_tag FROM report_lines l JOIN named n ON l.vip_main_no = n.vip_main_no"
oracle("clean_for_report", """SELECT vip_main_no, invoice_no, item_code, maincat_desc_cleaned, item_subcat_desc_cleaned, maincat_and_subcat,
 CAST(net_amt_hkd AS DOUBLE) AS net_amt_hkd FROM report_lines""")
oracle("tag_sales", """SELECT vip_main_no, invoice_no, item_code, CAST(net_amt_hkd AS DOUBLE) AS net_amt_hkd, persona, customer_tag FROM persona_lines""")
LABELS = list(PERSONA_NAMES.values())
oracle("persona_kpis", kpis("persona_lines", LABELS))
KNOWN = "CASE WHEN {0} IS NULL OR {0} = 'N/A' THEN 'Unknown' ELSE {0} END"
oracle("persona_category", money_pivot(KNOWN.format("item_subcat_desc_cleaned"), "persona_lines", LABELS, WINDOWED, "item_subcat_desc_cleaned"))
oracle("persona_category_buyers", count_cells(KNOWN.format("maincat_desc_cleaned"), "vip_main_no", "persona_lines", LABELS, WINDOWED, "maincat_desc_cleaned"))
oracle("persona_category_quantity", pivot(KNOWN.format("item_subcat_desc_cleaned"), "sum(sold_qty)", "persona_lines", LABELS, WINDOWED, "item_subcat_desc_cleaned"))
oracle("persona_members", count_cells("'members'", "vip_main_no", "persona_lines", LABELS, name="measure"))
CTES["persona_main"] = money_pivot(KNOWN.format("maincat_desc_cleaned"), "persona_lines", LABELS, WINDOWED, "maincat_desc_cleaned")
oracle("column_share", "SELECT maincat_desc_cleaned, " + ", ".join(
    f'round("{n}" / (SELECT sum("{n}") FROM persona_main) * 100, 1) AS "{n}"' for n in LABELS) + " FROM persona_main")

# -- sinks --------------------------------------------------------------------------

oracle("mart_update", ORACLES["channel_union"])
oracle("mart_sink", ORACLES["channel_union"] + " WHERE order_date >= DATE '1998-01-01'")
oracle("segment_sink", ORACLES["reclassify"])
oracle("feature_sink", "SELECT vip_main_no, " + rounded(FEATURES) + " FROM filled")
oracle("contact_csv", ORACLES["contact_list"])
for year, days in (("this", "DATE '1998-08-01' AND DATE '2001-07-31'"), ("before", "DATE '1997-08-01' AND DATE '2000-07-31'")):
    CTES[f"lines_{year}"] = f"SELECT * FROM feature_lines WHERE order_date BETWEEN {days}"
    CTES[f"shares_{year}"] = CTES["shares"].replace("feature_lines", f"lines_{year}")
    CTES[f"filled_{year}"] = CTES["filled"].replace("FROM shares", f"FROM shares_{year}")
oracle("stored_scaler", ORACLES["standardize"].replace("FROM filled)", "FROM filled_before)")
       .replace("FROM filled f", "FROM filled_this f"))
oracle("mart_demographic_sink", ORACLES["demographics_second_brand"])
oracle("mart_first_last_sink", ORACLES["first_last"])
