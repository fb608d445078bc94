"""Parameters of the jobs: dates, thresholds, rules and fixed value lists.

Nothing in the package reads the clock; every date arrives through ``Period``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import date

MEMBER = "vip_main_no"


def month_range(first: date, last: date) -> list[str]:
    """Every calendar month from ``first`` to ``last`` inclusive, as yyyyMM."""
    begin, end = first.year * 12 + first.month - 1, last.year * 12 + last.month - 1
    return [f"{m // 12:04d}{m % 12 + 1:02d}" for m in range(begin, end + 1)]


@dataclass(frozen=True)
class Period:
    """The mart window [first, last] and its trailing part [p12m_first, last]."""

    first: date
    p12m_first: date
    last: date
    mart_years: int = 3

    @property
    def trend_months(self) -> list[str]:
        return month_range(self.p12m_first, self.last)

    @property
    def p12m_after(self) -> str:
        """Months strictly after this one belong to the trailing year."""
        return f"{self.last.year - 1:04d}{self.last.month:02d}"


@dataclass(frozen=True)
class SegmentCuts:
    """Cut-offs of one brand and region."""

    slope_high: float
    slope_low: float
    clv_high: float
    clv_low: float
    engaged: float
    emerging: float


@dataclass(frozen=True)
class ChannelRule:
    """Which enriched sales lines count as valid for one channel.

    Empty tuples and ``None`` switch a test off.
    """

    brand: str
    price_above: int
    regions: tuple[str, ...]
    excluded_categories: tuple[str, ...]
    cashiers: tuple[str, ...] = ()
    shops: tuple[str, ...] = ()
    excluded_sellers: tuple[str, ...] = ()
    customers_only: bool = True
    sales_type: str | None = None
    nonzero_local_amount: bool = False
    positive_amount: bool = False


@dataclass(frozen=True)
class WalletSpec:
    """Share-of-wallet features of one dimension: output name -> source values."""

    by: str
    suffix: str
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)


# Thresholds by (brand code, region).
SEGMENT_CUTS = {
    ("BA", None): SegmentCuts(1500, 740, 3200, 1330, 12500, 4000),
    ("BP", "HK"): SegmentCuts(1050, 540, 2400, 1100, 6900, 3300),
    ("BP", "TW"): SegmentCuts(850, 450, 1500, 702, 3800, 2000),
}

# Tags in report order.
ACTIVE_TAGS = ("Engaged", "Emerging", "Low Value", "At Risk", "New Joiner")
CUSTOMER_TAGS = ACTIVE_TAGS + ("Inactive P12", "Inactive P24")

# Brands.
SALES_BRANDS = ("BA", "BP")
LOCATION_BRANDS = ("AU", "BA", "BP", "BI", "HB", "JB")

# Item categories left out of the sub-category table.
EXCLUDED_SUBCATEGORY_CATS = (
    "BA13", "BA12", "BA11",
    "BP10", "BP11", "BP12", "BP13", "BP14", "BP15", "BP88", "BP99",
    "ZZ", "ZZZ",
    "HB06", "HB07", "HB88",
)
SUBCATEGORY_RENAMES = {"FACE-CLEANSING": "FACE CLEANSING"}

# Sub-region -> city names, looked up only in districts marked TW-.
SUB_REGION_MARK = "TW-"
SUB_REGIONS = {
    "Northern TW": ("Hsinchu", "Taipei", "Taoyuan", "Xinbei"),
    "Central TW": ("Taichung",),
    "Southern TW": ("Kaohsiung", "Tainan"),
}

# Channel rules of the two-brand mart.
CHANNEL_RULES = {
    "BA": {
        "store": ChannelRule(
            brand="BA", price_above=20, regions=("HK", "MO"),
            excluded_categories=("BA13", "BA12", "BA11"),
            cashiers=("BAEXC",), sales_type="Product"),
        "online": ChannelRule(
            brand="BA", price_above=20, regions=("HK", "MO"),
            excluded_categories=("BA13", "BA12", "BA11"),
            shops=("BAEHKG02",), sales_type="Product"),
    },
    "BP": {
        "hk": ChannelRule(
            brand="BP", price_above=50, regions=("HK", "MO"),
            excluded_categories=("BP10", "BP11", "BP12", "BP13", "BP14", "BP15",
                                 "BP88", "BP99", "ZZ", "ZZZ"),
            cashiers=("CASHIER", "30241"), excluded_sellers=("sxd", "BP888"),
            customers_only=False, nonzero_local_amount=True),
        "tw": ChannelRule(
            brand="BP", price_above=0, regions=("TW",),
            excluded_categories=("BP10", "BP11", "BP15", "BP88", "BP99", "ZZ", "ZZZ"),
            cashiers=("CASHIER",), excluded_sellers=("sxd",), positive_amount=True),
    },
}

# The mart of the first brand alone has the same channels in one region.
ONE_BRAND_RULES = {name: replace(rule, regions=("HK",)) for name, rule in CHANNEL_RULES["BA"].items()}

# Attribute labels.
UNKNOWN_SEX = "C"
NATIONALITIES = ("Hong Kong", "Mainland China", "Macau")
NATIONALITIES_WITH_TW = NATIONALITIES + ("Taiwanese",)
AGE_LABELS = {
    "01": "< 25", "02": "26 - 30", "03": "31 - 35",
    "04": "36 - 40", "05": "41 - 50", "06": "> 51",
}

# Feature input filter.
DUMMY_BRANDS = ("JBZZZ", "ZZ")
DUMMY_CATEGORIES = ("ZZZ", "Dummy", "dummy")

# Share-of-wallet features kept for clustering.
WALLET_SPECS = (
    WalletSpec("item_subcat_desc", "_SOW_by_subcat", {
        "Conditioner": ("Conditioner",),
        "Shampoo": ("Shampoo",),
        "Style": ("Style",),
        "Treatment": ("Treatment",),
    }),
    WalletSpec("maincat_desc", "_SOW_by_maincat", {
        "Skin": ("Skin",),
        "Body": ("Body",),
    }),
    WalletSpec("item_product_line_desc", "_SOW_by_prodline", {
        "Botanical Repair": ("Botanical Repair",),
        "Color": ("Color Control", "Color Enhancers"),
        "Invati": ("Invati Advanced", "Invati Men"),
        "Others": (
            "Botancial Kinetcs", "Brilliant", "Chakra", "Cherry Almond", "Composition",
            "Curl", "Damage Remedy", "Holiday 05", "Light Elements", "Pure Abundance",
            "Sap Moss", "Smooth Fusion", "Stress-Fix", "Sun Care", "Tea", "Tulasara",
            "Volumizing"),
    }),
)
# Column left out by hand, and the feature order of the first cluster model.
DROPPED_FEATURES = ("Color_SOW_by_prodline",)
CLUSTER_FEATURES = (
    "Body_SOW_by_maincat", "Skin_SOW_by_maincat", "Botanical Repair_SOW_by_prodline",
    "Invati_SOW_by_prodline", "Treatment_SOW_by_subcat", "Others_SOW_by_prodline",
    "Style_SOW_by_subcat", "Conditioner_SOW_by_subcat", "Shampoo_SOW_by_subcat",
)

# Persona names by cluster id of the saved model.
PERSONA_NAMES = {
    0: "Haircare Enthusiasts",
    1: "Tress Treatment Devotees",
    2: "Shampoo Connoisseurs",
    3: "Beauty Style Seekers",
    4: "Skincare Enthusiasts",
}
# Label clean-up of the persona reports.
REPORT_MAINCAT_LABELS = {"gift": "GIFT", "ZZ": "Unknown", "Dummy": "Unknown"}
REPORT_SUBCAT_LABELS = {"ZZZ": "Unknown", "dummy": "Unknown", "Dummy": "Unknown", "gift": "GIFT"}
