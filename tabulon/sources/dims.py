"""Reference dimensions (S7): small, fixed-size tables built on the driver.

Each one has a size bound by construction (a constant list below), so
broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Indicator registry: id, label, category, unit, source, source_code,
# fallback_source, fallback_source_code.
HEALTH_INDICATORS = [
    ("life_expectancy", "Life Expectancy at Birth", "Mortality", "years", "WHO", "WHOSIS_000001", "OWID", "life-expectancy"),
    ("under5_mortality", "Under-5 Mortality Rate", "Mortality", "deaths per 1,000 live births", "WHO", "MDG_0000000007", "OWID", "child-mortality"),
    ("maternal_mortality", "Maternal Mortality Ratio", "Mortality", "deaths per 100,000 live births", "WHO", "MDG_0000000026", "OWID", "maternal-mortality"),
    ("dtp3_immunization", "DTP3 Immunization Coverage", "Immunization", "% of 1-year-olds", "WHO", "WHS4_100", "OWID", "share-of-children-immunized-dtp3"),
    ("owid_life_expectancy", "Life Expectancy (Long-run)", "Mortality", "years", "OWID", "life-expectancy", None, None),
    ("burden_of_disease", "Burden of Disease (DALYs per 100,000)", "Mortality", "age-standardized DALYs per 100,000 people", "OWID", "burden-of-disease-who", None, None),
    ("health_expenditure_per_capita", "Health Expenditure per Capita", "Economics", "PPP $ (current international $)", "OWID", "annual-healthcare-expenditure-per-capita", None, None),
    ("gdp_per_capita", "GDP per Capita", "Economics", "current international $", "OWID", "gdp-per-capita-worldbank", None, None),
]

# Region groups: name -> ISO-3 codes (overlapping, many-to-many).
REGION_GROUPS = {
    "Africa": "DZA AGO BEN BWA BFA BDI CPV CMR CAF TCD COM COD COG CIV DJI EGY GNQ ERI SWZ ETH GAB GMB GHA GIN GNB KEN LSO LBR LBY MDG MWI MLI MRT MUS MAR MOZ NAM NER NGA RWA STP SEN SYC SLE SOM ZAF SSD SDN TZA TGO TUN UGA ZMB ZWE",
    "Asia": "AFG ARM AZE BHR BGD BTN BRN KHM CHN CYP GEO IND IDN IRN IRQ ISR JPN JOR KAZ KWT KGZ LAO LBN MYS MDV MNG MMR NPL OMN PAK PHL QAT SAU SGP KOR LKA SYR TJK THA TLS TUR TKM ARE UZB VNM YEM PRK PSE TWN",
    "Europe": "ALB AND AUT BLR BEL BIH BGR HRV CZE DNK EST FIN FRA DEU GRC HUN ISL IRL ITA XKX LVA LIE LTU LUX MLT MDA MCO MNE NLD MKD NOR POL PRT ROU RUS SMR SRB SVK SVN ESP SWE CHE UKR GBR VAT",
    "North America": "CAN USA MEX BLZ CRI SLV GTM HND NIC PAN ATG BHS BRB CUB DMA DOM GRD HTI JAM KNA LCA VCT TTO",
    "Oceania": "AUS FJI KIR MHL FSM NRU NZL PLW PNG WSM SLB TON TUV VUT",
    "South America": "ARG BOL BRA CHL COL ECU GUY PRY PER SUR URY VEN",
    "Scandinavia": "DNK NOR SWE",
    "Nordic countries": "DNK FIN ISL NOR SWE",
    "East Asia": "CHN JPN MNG PRK KOR TWN",
    "Southeast Asia": "BRN KHM IDN LAO MYS MMR PHL SGP THA TLS VNM",
    "South Asia": "AFG BGD BTN IND MDV NPL PAK LKA",
    "Western Europe": "AUT BEL FRA DEU IRL LIE LUX MCO NLD PRT CHE GBR",
    "Eastern Europe": "BLR BGR CZE HUN POL MDA ROU RUS SVK UKR",
    "Latin America": "ARG BOL BRA CHL COL CRI CUB DOM ECU SLV GTM HTI HND MEX NIC PAN PRY PER URY VEN",
    "Middle East": "BHR CYP EGY IRN IRQ ISR JOR KWT LBN OMN PSE QAT SAU SYR TUR ARE YEM",
    "Sub-Saharan Africa": "AGO BEN BWA BFA BDI CPV CMR CAF TCD COM COD COG CIV DJI GNQ ERI SWZ ETH GAB GMB GHA GIN GNB KEN LSO LBR MDG MWI MLI MRT MUS MOZ NAM NER NGA RWA STP SEN SYC SLE SOM ZAF SSD SDN TZA TGO UGA ZMB ZWE",
}

# Audio-feature filter levels: feature -> level -> (lo, hi), both ends inclusive.
FILTER_LEVELS = {
    "energy": {"low": (0.0, 0.4), "medium": (0.4, 0.7), "high": (0.7, 1.0)},
    "valence": {"sad": (0.0, 0.3), "neutral": (0.3, 0.55), "happy": (0.55, 1.0)},
    "danceability": {"low": (0.0, 0.45), "medium": (0.45, 0.65), "high": (0.65, 1.0)},
}
# ---------------------------------------------------------------------------

REGISTRY_SCHEMA = (
    "id string, label string, category string, unit string, source string, "
    "source_code string, fallback_source string, fallback_source_code string, registry_pos int"
)


def registry_df(spark: SparkSession, entries=None) -> DataFrame:
    """Registry rows as data (J2, J9, A5, S15).  ``registry_pos`` keeps list order."""
    rows = [tuple(e) + (i,) for i, e in enumerate(entries if entries is not None else HEALTH_INDICATORS)]
    return spark.createDataFrame(rows, REGISTRY_SCHEMA)


def region_groups_df(spark: SparkSession, groups: dict | None = None) -> DataFrame:
    """One row per group with its ordered code list."""
    groups = groups if groups is not None else REGION_GROUPS
    rows = [(name, codes.split() if isinstance(codes, str) else list(codes)) for name, codes in groups.items()]
    return spark.createDataFrame(rows, "region string, codes array<string>")


def region_bridge_df(spark: SparkSession, groups: dict | None = None) -> DataFrame:
    """Exploded (region, country_code) bridge; many-to-many."""
    return region_groups_df(spark, groups).select("region", F.explode("codes").alias("country_code"))


def filter_levels_df(spark: SparkSession) -> DataFrame:
    rows = [(feat, level, float(lo), float(hi))
            for feat, levels in FILTER_LEVELS.items() for level, (lo, hi) in levels.items()]
    return spark.createDataFrame(rows, "feature string, level string, lo double, hi double")


# ---------------------------------------------------------------------------
# Drink catalog (category, name, profile, best_for) and toppings.
DRINK_MENU = [
    ("All Day Tea", "Black Tea with Milk Foam", "bold, smooth, creamy, and tea-forward", "a rich tea base with a creamy finish"),
    ("All Day Tea", "Black Tea (Ceylon)", "classic, robust, and refreshing", "a straightforward black tea flavor"),
    ("All Day Tea", "Green Tea (Jasmine)", "light, floral, fresh, and refreshing", "an aromatic tea without heavy milkiness"),
    ("All Day Tea", "Green Tea with Milk Foam", "fresh jasmine tea with a creamy finish", "floral tea with a little indulgence"),
    ("All Day Tea", "Oolong Tea", "smooth, earthy, gently roasted, and balanced", "a mellow tea with depth"),
    ("All Day Tea", "Oolong Tea with Milk Foam", "earthy, rounded, and creamy", "a roasted tea with a soft creamy finish"),
    ("Milk Tea", "Brown Sugar Black Milk Tea with Pearl", "rich, sweet, creamy, and chewy", "brown sugar flavor and a classic milk tea base"),
    ("Milk Tea", "Caramel Black Milk Tea with Pearl", "smooth, creamy, caramel-like, and sweet", "a dessert-like black milk tea"),
    ("Milk Tea", "Matcha Milk Tea with Pearls", "creamy, earthy, lightly sweet, and chewy", "a matcha fan who enjoys milk tea"),
    ("Milk Tea", "Earl Grey Milk Tea", "creamy, fragrant, and citrusy", "a milk tea with bergamot character"),
    ("Milk Tea", "Black Milk Tea", "smooth, comforting, and classic", "a traditional milk tea experience"),
    ("Milk Tea", "Green Milk Tea", "light, floral, creamy, and refreshing", "a gentler milk tea with floral notes"),
    ("Milk Tea", "Oolong Milk Tea", "smooth, mellow, roasted, and creamy", "a balanced milk tea with tea depth"),
    ("Milk Tea", "Brown Sugar Oolong Milk Tea with Pearl", "roasted, creamy, sweet, and chewy", "brown sugar with a deeper oolong base"),
    ("Milk Tea", "Oolong Milk Tea with Pearl", "earthy, creamy, and chewy", "an oolong milk tea with added texture"),
    ("Fruit Tea", "QQ Passionfruit Green Tea", "bright, tangy, refreshing, and textured", "passionfruit flavor with chewy toppings"),
    ("Fruit Tea", "Mango Green Tea", "juicy, tropical, sweet, and refreshing", "a sunny mango tea"),
    ("Fruit Tea", "Peach Green Tea", "fragrant, fruity, light, and refreshing", "a delicate peach tea"),
    ("Fruit Tea", "Strawberry Green Tea", "sweet, fruity, bright, and refreshing", "a berry-forward tea"),
    ("Fruit Tea", "Passionfruit Green Tea", "tangy, aromatic, and refreshing", "a sharper tropical fruit tea"),
    ("Fruit Tea", "Strawberry Limonada", "sweet, citrusy, fruity, and refreshing", "a strawberry lemonade-style drink"),
    ("Fruit Tea", "Mango Limonada", "tropical, citrusy, sweet, and refreshing", "a mango lemonade-style drink"),
    ("Fruit Tea", "Matcha Strawberry Milk Tea", "creamy, earthy, sweet, and fruity", "matcha with a strawberry twist"),
    ("Smoothies", "Taro Smoothie", "rich, nutty, creamy, and smooth", "a dessert-like taro treat"),
    ("Smoothies", "Mango Smoothie", "thick, tropical, sweet, and fruity", "a creamy mango escape"),
    ("Smoothies", "Strawberry Smoothie", "creamy, sweet, fruity, and familiar", "a classic strawberry smoothie"),
    ("Smoothies", "Matcha Smoothie", "creamy, earthy, and gently sweet", "a blended matcha drink"),
    ("Smoothies", "Mango Limonada Smoothie", "tropical, creamy, and citrusy", "mango with a bright lemonade lift"),
    ("Smoothies", "Strawberry Limonada Smoothie", "fruity, creamy, and citrusy", "strawberry with a refreshing citrus lift"),
    ("Smoothies", "Milk Foam Peach Slush with Star Jelly", "peachy, icy, creamy, and playful", "a refreshing slush with a creamy topping"),
    ("Creations", "Taro Milk Tea with Pearls", "creamy, smooth, nutty, and chewy", "a classic taro milk drink with pearls"),
    ("Creations", "Crème Brulee Strawberry Latte", "sweet, creamy, strawberry-forward, and indulgent", "a dessert-inspired strawberry latte"),
    ("Creations", "Brown Sugar Milk with Pearls", "sweet, milky, rich, and chewy", "a caffeine-free brown sugar option"),
    ("Creations", "Taro Milk", "smooth, creamy, and nutty", "a simple taro milk drink"),
    ("Creations", "Strawberry Milk", "creamy, sweet, and fruity", "a non-tea strawberry drink"),
    ("Creations", "Chocolate Milk", "rich, creamy, and chocolatey", "a familiar chocolate treat"),
    ("Creations", "Caramel Milk", "smooth, creamy, and caramel-like", "a sweet, non-tea caramel drink"),
]
TOPPINGS = [
    "Milk Foam", "Pearls", "Coconut Jelly", "Cookie Crumbs", "Aloe",
    "Peach Flavour Star Shape Coconut Jelly", "Crème Brulee Milk Foam",
]
# ---------------------------------------------------------------------------


def catalog_df(spark: SparkSession) -> DataFrame:
    rows = [(i, c, n, p, b) for i, (c, n, p, b) in enumerate(DRINK_MENU)]
    return spark.createDataFrame(rows, "item_pos long, category string, name string, profile string, best_for string")
