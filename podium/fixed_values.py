"""Fixed values.

Word lists, lookup tables, constants and formats that results depend on. They are data, not logic: every
other module reads them from here, and nothing here is computed.
"""

# --- statuses, frequencies ---------------------------------------------------------------------------
STATUSES = ("VERIFIED", "SUPPORTED", "ESTIMATED", "UNKNOWN", "CONFLICTING", "REJECTED")

FREQUENCY_HINTS = {
    "annual": "annual", "yearly": "annual", "year": "annual",
    "quarterly": "quarterly", "quarter": "quarterly",
    "monthly": "monthly", "month": "monthly",
    "weekly": "weekly", "week": "weekly",
    "daily": "daily", "day": "daily",
}

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")

# --- date shapes -------------------------------------------------------------------------------------
# Spellings accepted when a table cell is asked "is this a date at all?" (any one of them).
DATE_SHAPES = (
    r"-?\d{1,5}(-\d{2}(-\d{2})?)?",
    r"-?\d{1,5}-Q[1-4]",
    r"(?i:Q[1-4]\s*-?\d{1,5})",
    r"-?\d{1,5}/\d{1,2}(/\d{1,2})?",
    r"\d{1,2}/-?\d{1,5}",
    r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+-?\d{1,5})",
    r"(?i:-?\d{1,5}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*)",
)
NORMALISED_DATE = r"^-?\d{1,5}(-\d{2}(-\d{2})?|(-Q[1-4]))?$"

# --- units: canonical | dimension | factor | spellings --------------------------------------------------
UNITS = """
count | count | 1 | count; counts; units; unit; number; no; qty; quantity; people; persons; users; user; subscribers; subscriber; passengers; passenger; visitors; downloads; sales; copies; installs
count | count | 1e3 | k; thousand; thousands; k units; 000
count | count | 1e6 | m; mn; million; millions; mio
count | count | 1e9 | bn; b; billion; billions
count | count | 1e12 | tn; trillion; trillions
percent | ratio | 1 | %; percent; pct; percentage; share
USD | currency | 1 | usd; $; us$; dollar; dollars; us dollar; current us$
USD | currency | 1e6 | usd million; million usd; us$ million; mn usd
USD | currency | 1e9 | usd billion; billion usd; us$ billion; bn usd
INR | currency | 1 | inr; rs; rupee; rupees
EUR | currency | 1 | eur; euro; euros
GBP | currency | 1 | gbp; pound; pounds
kg | mass | 1 | kg; kilogram; kilograms
kg | mass | 1e3 | t; tonne; tonnes; metric ton; metric tons; mt
kg | mass | 1e6 | kt; kilotonne; kilotonnes
kg | mass | 1e-3 | g; gram; grams
kg | mass | 0.45359237 | lb; pound mass; pounds mass
barrel | volume | 1 | bbl; barrel; barrels; oil barrel
litre | volume | 1 | l; litre; litres; liter; liters
m3 | volume | 1 | m3; cubic metre; cubic meter; cubic meters
km | distance | 1 | km; kilometer; kilometers
km | distance | 1.609344 | mi; mile; miles
kWh | energy | 1 | kwh; kilowatt hour; kilowatt hours
kWh | energy | 1e6 | gwh
kWh | energy | 1e3 | mwh
kWh | energy | 1e9 | twh
W | power | 1 | w; watt; watts
W | power | 1e6 | mw
W | power | 1e9 | gw
W | power | 1e12 | tw
tco2 | emissions | 1 | tco2; tonnes co2; tonnes of co2; tco2e
tco2 | emissions | 1e3 | ktco2
tco2 | emissions | 1e6 | mtco2
ha | area | 1 | ha; hectare; hectares
km2 | area | 1 | km2; km²; sq km; sqkm; square kilometre; square kilometer
years | time | 1 | years; year; yrs
per 100 people | rate | 1 | per 100 people; per 100
"""

# Words that only scale or rename a unit when two sources are compared: base | multiplier | words.
UNIT_WORDS = """
count | 1e6 | million; millions; mn; mln; m
count | 1e9 | billion; billions; bn; bln; b
count | 1e12 | trillion; trillions; tn; t
count | 1e3 | thousand; thousands; k
percent | 1 | percent; percentage; pct; %
count | 1 | count
number | 1 | number
people | 1 | people
persons | 1 | persons
total | 1 | total
index | 1 | index
usd | 1 | usd
USD | 1 | dollar; dollars
"""

# Scale suffixes of a number cell (power of ten, words), tried in this order.
NUMBER_SCALES = ((12, "trillion|tn|t"), (9, "billion|bn|bln|b"), (6, "million|mn|mln|m"), (3, "thousand|k"))
CURRENCY_SIGNS = "$€£¥₹"

# --- entities ----------------------------------------------------------------------------------------
CORPORATE_SUFFIXES = (r"inc|ltd|llc|corp|corporation|co|company|gmbh|s\.?a\.?|s\.?r\.?l\.?|pty|plc|bv|nv|ab|asa|"
                      r"oyj|k\.?k\.?")

ENTITY_ALIASES = """
usa = United States
u.s.a. = United States
u.s. = United States
united states of america = United States
uk = United Kingdom
u.k. = United Kingdom
great britain = United Kingdom
uae = United Arab Emirates
south korea = Korea, Rep.
republic of korea = Korea, Rep.
korea, south = Korea, Rep.
north korea = Korea, Dem. People's Rep.
russia = Russian Federation
vietnam = Viet Nam
iran = Iran, Islamic Rep.
syria = Syrian Arab Republic
laos = Lao PDR
moldova = Moldova, Rep.
macedonia = North Macedonia
ivory coast = Cote d'Ivoire
côte d'ivoire = Cote d'Ivoire
tanzania = Tanzania, United Rep.
bolivia = Bolivia, Plurinational State of
venezuela = Venezuela, RB
egypt = Egypt, Arab Rep.
yemen = Yemen, Rep.
kyrgyzstan = Kyrgyz Republic
slovakia = Slovak Republic
czechia = Czech Republic
czech republic = Czech Republic
eswatini = Eswatini
swaziland = Eswatini
turkey = Turkiye
türkiye = Turkiye
cape verde = Cabo Verde
east timor = Timor-Leste
brunei = Brunei Darussalam
gambia = Gambia, The
bahamas = Bahamas, The
congo = Congo, Rep.
democratic republic of the congo = Congo, Dem. Rep.
drc = Congo, Dem. Rep.
hong kong = Hong Kong SAR, China
macao = Macao SAR, China
palestine = West Bank and Gaza
republic of congo = Congo, Rep.
ivory coast republic = Cote d'Ivoire
united arab emirates = United Arab Emirates
saudi = Saudi Arabia
south africa = South Africa
new zealand = New Zealand
sri lanka = Sri Lanka
costa rica = Costa Rica
dominican republic = Dominican Republic
el salvador = El Salvador
puerto rico = Puerto Rico
trinidad and tobago = Trinidad and Tobago
bosnia = Bosnia and Herzegovina
bosnia and herzegovina = Bosnia and Herzegovina
north macedonia = North Macedonia
timor-leste = Timor-Leste
eswatini (swaziland) = Eswatini
"""

# Two-letter codes that stand for a group of countries and so have no flag.
AGGREGATE_CODES = ("XX", "XO", "XS", "XE", "AN", "XU", "OC")

# --- column detection --------------------------------------------------------------------------------
ENTITY_COLUMNS = ("entity", "country", "country name", "name", "region", "territory", "location", "geo", "geography",
                  "state", "nation", "brand", "company", "item", "product", "label", "browser", "empire", "dynasty",
                  "kingdom", "platform", "app", "language", "team", "club", "city", "player", "athlete", "artist",
                  "song", "movie", "film", "title", "subject", "category", "competitor", "candidate", "party",
                  "university", "school")
WIDE_ENTITY_COLUMNS = ("entity", "country", "country name", "name", "region", "territory", "location", "nation")
DATE_COLUMNS = ("year", "date", "time", "period", "month", "quarter", "day", "datetime", "fiscal year")
RESERVED_COLUMNS = ("code", "iso", "iso3", "iso_code", "slug", "continent", "flag", "entity_id")
MEASURE_WORDS = ("value|population|total|amount|count|number|sales|users|spend|gdp|production|share|percent|rate|"
                 "emission|revenue|profit|income|deaths|cases|capacity|output|volume|headcount|customers")
PERSON_COLUMN_WORDS = "cast|actor|actress|player|athlete|artist|performer|starring|people|personnel"
JSON_ENVELOPES = ("rows", "data", "records", "observations", "items", "results")

# --- text rules: topics, directions, units ----------------------------------------------------------------
TOPIC_WORDS = (
    ("economy", r"\b(poverty|poor|inequality|gini)\b"),
    ("economy", r"\b(gdp|economy|economic|income|debt|inflation|trade|export|import)\b"),
    ("population", r"\b(population|demograph|birth|death|migration|urban)\b"),
    ("health", r"\b(health|disease|mortality|life expectancy|hospital|vaccine)\b"),
    ("energy", r"\b(energy|electricity|oil|gas|coal|solar|wind|nuclear|renewable)\b"),
    ("environment", r"\b(climate|carbon|co2|emission|temperature|forest|pollution)\b"),
    ("education", r"\b(school|education|literacy|university|student)\b"),
    ("labour", r"\b(job|employment|unemployment|labour|labor|wage)\b"),
    ("agriculture", r"\b(farm|crop|agriculture|food|wheat|rice)\b"),
    ("technology", r"\b(browser|social media|internet|smartphone|app |apps|platform|website)\b"),
    ("finance", r"\b(stock|market cap|company|companies|bank|finance)\b"),
    ("india", r"\b(india|indian)\b"),
    ("sports", r"\b(sport|football|cricket|olympic|fifa)\b"),
    ("industry", r"\b(industry|manufacturing|steel|cement)\b"),
)
SMALLEST_FIRST_WORDS = ("poorest|smallest|lowest|least|cheapest|slowest|shortest|bottom|worst|least-populous|"
                        "smallest-population")
YEAR_RANGE = r"(?:from\s+)?(\d{1,5})\s*(bc|bce|ad|ce)?\s*(?:to|through|thru|-|–|until)\s*(\d{1,5})\s*(bc|bce|ad|ce)?"
MONEY_METRIC = (r"box[\s-]?office|earnings?|revenue|gross|salary|salaries|wages?|income|price|cost|dollar|usd|\bgdp\b|"
                r"market[\s-]?cap|boxoffice")
COUNT_LIKE_UNITS = ("count", "counts", "number", "numbers", "quantity", "quantities", "index", "indices", "rank",
                    "ranks")
TABLE_UNIT_WORDS = (("percent", r"%|percent|share|rate|ratio"),
                    ("USD", r"\b(usd|dollar|revenue|gross|box office|budget|income|price|cost|spend|gdp)\b"),
                    ("people", r"\b(population|people)\b"))
INDICATOR_UNIT_WORDS = (("percent", r"\(%|%\s*of|percent"), ("USD", r"us\$|\$|dollar|gdp|gni"))
# Words of a directly fetched table: unit | words in the headers | words in the topic.
FETCHED_UNIT_WORDS = (("percent", r"%|percent|share|rate|ratio", r"percent|share|rate"),
                      ("USD", r"\b(usd|dollar|gdp|income|price|cost|revenue)\b", None),
                      ("km²", r"\b(km2|km²|sq\s?km|area)\b", r"\b(area|land area)\b"),
                      ("people", r"\bpopulation\b", r"\bpopulation\b"))
NAME_MATCH_STOP_WORDS = ("the", "of", "by", "in", "and", "most", "popular", "best", "selling", "top", "largest",
                         "world", "global")

# --- urls, hosts ---------------------------------------------------------------------------------------
TRACKING_PARAMS = r"^(utm_|mc_|(fbclid|gclid|ref)(=|$))"
AUTHORITATIVE_HOSTS = ("worldbank.org", "data.worldbank.org", "api.worldbank.org", "databank.worldbank.org",
                       "data.un.org", "unstats.un.org", "population.un.org", "oecd.org", "stats.oecd.org",
                       "data.oecd.org", "ourworldindata.org", "data.europa.eu", "ec.europa.eu",
                       "eurostat.ec.europa.eu", "fred.stlouisfed.org", "data.gov", "census.gov", "api.census.gov",
                       "bls.gov", "bea.gov", "who.int", "data.who.int", "imf.org", "data.imf.org", "fao.org",
                       "fenixservices.fao.org")

# --- scores and thresholds -------------------------------------------------------------------------------
SOURCE_WEIGHTS = {"authority": 0.25, "directness": 0.2, "coverage": 0.15, "machine_readable": 0.1,
                  "methodology": 0.15, "recency": 0.05, "consistency": 0.1}
SCORECARD_SCALES = {"data_completeness": ("observations", 400), "historical_depth": ("distinct_dates", 40),
                    "source_quality": ("source_quality", 1), "entity_count": ("entities", 15),
                    "visual_potential": ("entities", 10), "change_frequency": ("distinct_leaders", 5),
                    "audience_clarity": ("entities", 8), "update_potential": ("distinct_dates", 25)}
SNAPSHOT_OFFSETS = (0, 1, -1, 2, -2, 7, -7)
SPOTLIGHT_LABELS = ("1970", "1980", "1990", "2000", "2010", "2020")
SMALLEST_BAR_SCALE = 2.220446049250313e-16
PALETTE = ("#2563eb", "#dc2626", "#f59e0b", "#059669", "#7c3aed", "#0891b2", "#db2777", "#65a30d", "#ea580c",
           "#4338ca", "#0d9488", "#b91c1c", "#4d7c0f", "#9333ea", "#0369a1", "#c2410c", "#1e40af", "#be123c",
           "#a16207", "#15803d", "#6d28d9", "#0e7490", "#9d174d", "#3f6212")

# --- source registry: name | url | kind | access | priority | categories ------------------------------------
SOURCE_REGISTRY = """
Our World in Data | https://ourworldindata.org/ | dataset | download | 1 | global, long-timeseries
World Bank Open Data | https://data.worldbank.org/ | api | api | 1 | country, annual
Data Commons | https://datacommons.org/ | api | api | 1 | place, cross-source
UNdata | https://data.un.org/ | api | api | 2 | country
OECD | https://www.oecd.org/en/data.html | api | api | 2 | country
Eurostat | https://ec.europa.eu/eurostat/ | api | api | 2 | country, region
Data.gov | https://data.gov/ | api | api | 3 | dataset-catalogue
Kaggle Datasets | https://www.kaggle.com/datasets | dataset | api | 6 | dataset-catalogue
Hugging Face Datasets | https://huggingface.co/datasets | dataset | api | 7 | dataset-catalogue
AWS Open Data Registry | https://registry.opendata.aws/ | dataset | web | 7 | dataset-catalogue
Google Dataset Search | https://datasetsearch.research.google.com/ | search | web | 0 | discovery
Visualization Datasets | https://visdatasets.github.io/ | directory | web | 9 | discovery
Feed Me Data | https://feedmedata.ai/datasets | directory | web | 9 | discovery
"""

# --- tiered sources: tier | name | topics ---------------------------------------------------------------------
TIERED_SOURCES = """
1 | World Bank Open Data | economy, population, health, education, energy, environment, labour, agriculture, trade
1 | UNdata | population, health, education, agriculture, energy, trade, environment
1 | UN SDG Database | economy, health, education, environment, energy, population
1 | OECD Data Explorer | economy, labour, education, energy, industry
1 | IMF Data | economy, finance
1 | WHO Global Health Observatory | health
1 | FAOSTAT | agriculture
1 | ILOSTAT | labour
1 | UNESCO Institute for Statistics | education
1 | ITU DataHub | technology
1 | UN Comtrade | trade
1 | WTO Stats | trade
1 | IEA Data | energy
1 | FRED | economy, finance, labour
1 | Eurostat | economy, population, energy, labour, transport
1 | UN Population Division (WPP) | population
1 | U.S. EIA Open Data | energy
1 | Data.gov.in | india
1 | RBI DBIE | india, economy, finance
1 | Census of India | india, population
2 | Our World in Data | population, health, economy, energy, environment, education, technology, agriculture
2 | Data Commons | population, economy, health, energy, environment
2 | Ember Energy Data | energy, environment
2 | Climate Watch | environment, energy
2 | Global Carbon Atlas | environment
2 | Energy Institute Statistical Review | energy
2 | IHME GHDx | health
2 | UNICEF Data | health, population, education
2 | StatCounter GlobalStats | technology
2 | DataReportal | technology
2 | CompaniesMarketCap | finance, economy
2 | Macrotrends | finance, economy
2 | OEC | trade, economy
2 | UNIDO Statistics | industry
2 | World Resources Institute | environment, energy
2 | Global Forest Watch | environment
2 | Penn World Table | economy
3 | Google Dataset Search |
3 | Kaggle Datasets |
3 | Hugging Face Datasets |
3 | AWS Open Data Registry |
3 | Data.gov |
3 | Data.europa.eu |
4 | Zenodo |
4 | Figshare |
4 | Internet Archive |
4 | Common Crawl |
4 | Natural Earth |
"""


def table(text: str, sep: str = "|") -> list[list[str]]:
    """Rows of one of the text tables above, cells trimmed."""
    return [[cell.strip() for cell in line.split(sep)] for line in text.strip().splitlines()]
