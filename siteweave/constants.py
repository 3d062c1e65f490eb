"""Word lists, code tables, patterns and thresholds.

Everything in this module is data that results depend on. Logic lives elsewhere.
"""

from __future__ import annotations

# --- Fixed values: sources -------------------------------------------------------------------

SOURCES = ("epa_echo", "epa_tri", "nhtsa", "census_cbp", "osha", "usda_fsis", "manual")
AGGREGATE_SOURCES = ("census_cbp",)

# --- Fixed values: states --------------------------------------------------------------------

US_STATES = (
    ("AL", "Alabama"), ("AK", "Alaska"), ("AZ", "Arizona"), ("AR", "Arkansas"),
    ("CA", "California"), ("CO", "Colorado"), ("CT", "Connecticut"), ("DE", "Delaware"),
    ("FL", "Florida"), ("GA", "Georgia"), ("HI", "Hawaii"), ("ID", "Idaho"),
    ("IL", "Illinois"), ("IN", "Indiana"), ("IA", "Iowa"), ("KS", "Kansas"),
    ("KY", "Kentucky"), ("LA", "Louisiana"), ("ME", "Maine"), ("MD", "Maryland"),
    ("MA", "Massachusetts"), ("MI", "Michigan"), ("MN", "Minnesota"), ("MS", "Mississippi"),
    ("MO", "Missouri"), ("MT", "Montana"), ("NE", "Nebraska"), ("NV", "Nevada"),
    ("NH", "New Hampshire"), ("NJ", "New Jersey"), ("NM", "New Mexico"), ("NY", "New York"),
    ("NC", "North Carolina"), ("ND", "North Dakota"), ("OH", "Ohio"), ("OK", "Oklahoma"),
    ("OR", "Oregon"), ("PA", "Pennsylvania"), ("RI", "Rhode Island"), ("SC", "South Carolina"),
    ("SD", "South Dakota"), ("TN", "Tennessee"), ("TX", "Texas"), ("UT", "Utah"),
    ("VT", "Vermont"), ("VA", "Virginia"), ("WA", "Washington"), ("WV", "West Virginia"),
    ("WI", "Wisconsin"), ("WY", "Wyoming"), ("DC", "District of Columbia"), ("PR", "Puerto Rico"),
)
STATE_CODES = tuple(code for code, _ in US_STATES)
# Exports are limited to the fifty states and DC.
EXPORT_STATE_CODES = tuple(code for code in STATE_CODES if code != "PR")
# Territories a seed file may name on top of the table above.
EXTRA_TERRITORIES = (("GU", "Guam"), ("VI", "Virgin Islands"))

FIPS_TO_STATE = (
    ("01", "AL"), ("02", "AK"), ("04", "AZ"), ("05", "AR"), ("06", "CA"), ("08", "CO"),
    ("09", "CT"), ("10", "DE"), ("11", "DC"), ("12", "FL"), ("13", "GA"), ("15", "HI"),
    ("16", "ID"), ("17", "IL"), ("18", "IN"), ("19", "IA"), ("20", "KS"), ("21", "KY"),
    ("22", "LA"), ("23", "ME"), ("24", "MD"), ("25", "MA"), ("26", "MI"), ("27", "MN"),
    ("28", "MS"), ("29", "MO"), ("30", "MT"), ("31", "NE"), ("32", "NV"), ("33", "NH"),
    ("34", "NJ"), ("35", "NM"), ("36", "NY"), ("37", "NC"), ("38", "ND"), ("39", "OH"),
    ("40", "OK"), ("41", "OR"), ("42", "PA"), ("44", "RI"), ("45", "SC"), ("46", "SD"),
    ("47", "TN"), ("48", "TX"), ("49", "UT"), ("50", "VT"), ("51", "VA"), ("53", "WA"),
    ("54", "WV"), ("55", "WI"), ("56", "WY"),
)

# --- Fixed values: industry codes ------------------------------------------------------------

SECTOR_CODES = ("31", "32", "33")

SUBSECTORS = (
    ("311", "Food Manufacturing"),
    ("312", "Beverage and Tobacco Product Manufacturing"),
    ("313", "Textile Mills"),
    ("314", "Textile Product Mills"),
    ("315", "Apparel Manufacturing"),
    ("316", "Leather and Allied Product Manufacturing"),
    ("321", "Wood Product Manufacturing"),
    ("322", "Paper Manufacturing"),
    ("323", "Printing and Related Support Activities"),
    ("324", "Petroleum and Coal Products Manufacturing"),
    ("325", "Chemical Manufacturing"),
    ("326", "Plastics and Rubber Products Manufacturing"),
    ("327", "Nonmetallic Mineral Product Manufacturing"),
    ("331", "Primary Metal Manufacturing"),
    ("332", "Fabricated Metal Product Manufacturing"),
    ("333", "Machinery Manufacturing"),
    ("334", "Computer and Electronic Product Manufacturing"),
    ("335", "Electrical Equipment, Appliance, and Component Manufacturing"),
    ("336", "Transportation Equipment Manufacturing"),
    ("337", "Furniture and Related Product Manufacturing"),
    ("339", "Miscellaneous Manufacturing"),
)

INDUSTRY_GROUPS = (
    ("3111", "Animal Food Manufacturing"),
    ("3112", "Grain and Oilseed Milling"),
    ("3113", "Sugar and Confectionery Product Manufacturing"),
    ("3114", "Fruit and Vegetable Preserving and Specialty Food Manufacturing"),
    ("3115", "Dairy Product Manufacturing"),
    ("3116", "Animal Slaughtering and Processing"),
    ("3118", "Bakeries and Tortilla Manufacturing"),
    ("3119", "Other Food Manufacturing"),
    ("3241", "Petroleum and Coal Products Manufacturing"),
    ("3251", "Basic Chemical Manufacturing"),
    ("3252", "Resin, Synthetic Rubber, and Artificial Fibers"),
    ("3253", "Pesticide, Fertilizer, and Other Agricultural Chemical Manufacturing"),
    ("3254", "Pharmaceutical and Medicine Manufacturing"),
    ("3255", "Paint, Coating, and Adhesive Manufacturing"),
    ("3256", "Soap, Cleaning Compound, and Toilet Preparation Manufacturing"),
    ("3259", "Other Chemical Product and Preparation Manufacturing"),
    ("3261", "Plastics Product Manufacturing"),
    ("3262", "Rubber Product Manufacturing"),
    ("3311", "Iron and Steel Mills and Ferroalloy Manufacturing"),
    ("3312", "Steel Product Manufacturing from Purchased Steel"),
    ("3313", "Alumina and Aluminum Production and Processing"),
    ("3314", "Nonferrous Metal Production and Processing"),
    ("3315", "Foundries"),
    ("3321", "Forging and Stamping"),
    ("3323", "Architectural and Structural Metals Manufacturing"),
    ("3324", "Boiler, Tank, and Shipping Container Manufacturing"),
    ("3327", "Machine Shops; Turned Product; and Screw, Nut, and Bolt Manufacturing"),
    ("3328", "Coating, Engraving, Heat Treating, and Allied Activities"),
    ("3329", "Other Fabricated Metal Product Manufacturing"),
    ("3331", "Agriculture, Construction, and Mining Machinery Manufacturing"),
    ("3332", "Industrial Machinery Manufacturing"),
    ("3334", "Ventilation, Heating, AC, and Commercial Refrigeration Equipment Manufacturing"),
    ("3336", "Engine, Turbine, and Power Transmission Equipment Manufacturing"),
    ("3339", "Other General Purpose Machinery Manufacturing"),
    ("3341", "Computer and Peripheral Equipment Manufacturing"),
    ("3342", "Communications Equipment Manufacturing"),
    ("3344", "Semiconductor and Other Electronic Component Manufacturing"),
    ("3345", "Navigational, Measuring, Electromedical, and Control Instruments"),
    ("3351", "Electric Lighting Equipment Manufacturing"),
    ("3353", "Electrical Equipment Manufacturing"),
    ("3359", "Other Electrical Equipment and Component Manufacturing"),
    ("3361", "Motor Vehicle Manufacturing"),
    ("3362", "Motor Vehicle Body and Trailer Manufacturing"),
    ("3363", "Motor Vehicle Parts Manufacturing"),
    ("3364", "Aerospace Product and Parts Manufacturing"),
    ("3366", "Ship and Boat Building"),
    ("3369", "Other Transportation Equipment Manufacturing"),
    ("3391", "Medical Equipment and Supplies Manufacturing"),
    ("3399", "Other Miscellaneous Manufacturing"),
)

# key, label, code prefixes
CATEGORIES = (
    ("aerospace", "Aerospace & Defense", ("3364",)),
    ("automobiles", "Automobiles & Vehicles", ("3361", "3362", "3363", "3365", "3366", "3367", "3369")),
    ("metals", "Metals", ("331", "332")),
    ("chemicals", "Chemicals & Energy", ("324", "325")),
    ("minerals", "Minerals", ("327",)),
    ("machinery", "Machinery", ("333",)),
    ("electronics", "Electronics", ("334", "335")),
    ("plastics", "Plastics & Rubber", ("326",)),
    ("organics", "Organics & Textiles", ("313", "314", "315", "316", "321", "322")),
    ("food", "Food & Beverage", ("311", "312")),
    ("general", "General Manufacturing", ("323", "337", "339")),
)
DEFAULT_CATEGORY_LABEL = "Manufacturing"

# SIC major group (first two digits) to an approximate subsector
SIC_GROUP_TO_NAICS = (
    ("20", "311"), ("21", "312"), ("22", "313"), ("23", "313"), ("24", "321"), ("25", "337"),
    ("26", "322"), ("27", "323"), ("28", "325"), ("29", "324"), ("30", "326"), ("31", "316"),
    ("32", "327"), ("33", "331"), ("34", "332"), ("35", "333"), ("36", "335"), ("37", "336"),
    ("38", "334"), ("39", "339"),
)

# Sector labels used when an unlabelled company is given its first sector
SECTOR_LABELS_ASSIGN = (
    ("311", "Food Manufacturing"), ("312", "Beverage & Tobacco"), ("313", "Textile Mills"),
    ("314", "Textile Products"), ("315", "Apparel"), ("316", "Leather & Allied"),
    ("321", "Wood Products"), ("322", "Paper Manufacturing"), ("323", "Printing"),
    ("324", "Petroleum & Coal"), ("325", "Chemical Manufacturing"), ("326", "Plastics & Rubber"),
    ("327", "Nonmetallic Minerals"), ("331", "Primary Metals"), ("332", "Fabricated Metals"),
    ("333", "Machinery"), ("334", "Computer & Electronics"), ("335", "Electrical Equipment"),
    ("336", "Transportation Equipment"), ("337", "Furniture"), ("339", "Miscellaneous Manufacturing"),
)
# Sector labels used when every company's sector is refreshed
SECTOR_LABELS_REFRESH = (
    ("311", "Food Manufacturing"), ("312", "Beverage & Tobacco"), ("313", "Textile Mills"),
    ("314", "Textile Product Mills"), ("315", "Apparel Manufacturing"), ("316", "Leather & Allied Products"),
    ("321", "Wood Product Manufacturing"), ("322", "Paper Manufacturing"), ("323", "Printing & Related"),
    ("324", "Petroleum & Coal Products"), ("325", "Chemical Manufacturing"), ("326", "Plastics & Rubber Products"),
    ("327", "Nonmetallic Mineral Products"), ("331", "Primary Metal Manufacturing"),
    ("332", "Fabricated Metal Products"), ("333", "Machinery Manufacturing"),
    ("334", "Computer & Electronic Products"), ("335", "Electrical Equipment & Appliances"),
    ("336", "Transportation Equipment"), ("337", "Furniture & Related Products"),
    ("339", "Miscellaneous Manufacturing"),
)
DEFAULT_SECTOR_LABEL = "Manufacturing"

# --- Fixed values: coordinates ---------------------------------------------------------------

EARTH_RADIUS_M = 6371000.0
# name, min latitude, max latitude, min longitude, max longitude
US_BOXES = (
    ("lower48", 24.0, 49.5, -125.5, -66.0),
    ("alaska", 51.0, 71.5, -180.0, -129.0),
    ("hawaii", 18.5, 22.5, -160.5, -154.5),
    ("puerto_rico", 17.5, 18.6, -67.5, -65.5),
)
# distance in metres (exclusive) and the score below it
GEO_STEPS = ((100, 100), (500, 85), (1000, 60), (5000, 30))

# --- Fixed values: addresses -----------------------------------------------------------------

UNIT_PATTERN = r"\b(SUITE|STE|UNIT|APT|#|ROOM|RM|BLDG|BUILDING|FLOOR|FL)\s*\.?\s*\S+"

# In the order they are applied. Spellings with a dot are left out: the plain ones match before the dot already.
DIRECTIONALS = (
    ("N", "NORTH"), ("S", "SOUTH"), ("E", "EAST"), ("W", "WEST"),
    ("NE", "NORTHEAST"), ("NW", "NORTHWEST"), ("SE", "SOUTHEAST"), ("SW", "SOUTHWEST"),
)

STREET_TYPES = (
    ("ST", "STREET"), ("ST.", "STREET"), ("AVE", "AVENUE"), ("AVE.", "AVENUE"), ("BLVD", "BOULEVARD"),
    ("BLVD.", "BOULEVARD"), ("DR", "DRIVE"), ("DR.", "DRIVE"), ("RD", "ROAD"), ("RD.", "ROAD"), ("LN", "LANE"),
    ("LN.", "LANE"), ("CT", "COURT"), ("CT.", "COURT"), ("CIR", "CIRCLE"), ("CIR.", "CIRCLE"), ("PL", "PLACE"),
    ("PL.", "PLACE"), ("TER", "TERRACE"), ("TERR", "TERRACE"), ("PKY", "PARKWAY"), ("PKWY", "PARKWAY"),
    ("HWY", "HIGHWAY"), ("HWY.", "HIGHWAY"), ("FWY", "FREEWAY"), ("TPKE", "TURNPIKE"), ("TPK", "TURNPIKE"),
    ("WAY", "WAY"), ("TRL", "TRAIL"), ("SQ", "SQUARE"),
)

# --- Fixed values: matching ------------------------------------------------------------------

WEIGHTS = {"name": 0.35, "geo": 0.30, "address": 0.20, "naics": 0.15}
AUTO_MATCH_THRESHOLD = 90
REVIEW_THRESHOLD = 60
REGISTRY_SCORE = 99
MAX_BLOCK = 500
# shared prefix length and score; an equal code scores 100
NAICS_STEPS = ((4, 70), (3, 50), (2, 30))

# --- Fixed values: survivorship (first source wins) ------------------------------------------

FIELD_PRIORITY = {
    "name": ("epa_echo", "epa_tri", "nhtsa", "osha", "usda_fsis", "manual"),
    "address": ("epa_echo", "epa_tri", "nhtsa", "osha", "usda_fsis"),
    "city": ("epa_echo", "epa_tri", "nhtsa", "osha", "usda_fsis"),
    "state": ("epa_echo", "epa_tri", "nhtsa", "osha", "usda_fsis"),
    "zip": ("epa_echo", "epa_tri", "nhtsa", "osha", "usda_fsis"),
    "county": ("epa_echo", "epa_tri", "osha", "usda_fsis"),
    "latitude": ("epa_echo", "epa_tri", "osha"),
    "longitude": ("epa_echo", "epa_tri", "osha"),
    "company_name": ("epa_tri", "nhtsa", "manual", "epa_echo", "osha"),
    "naics_code": ("epa_echo", "epa_tri", "osha", "usda_fsis"),
    "employee_count": ("osha",),
}

# --- Fixed values: company names -------------------------------------------------------------

BLOCKED_NAMES = (
    "na", "n/a", "n.a", "n.a.", "n a", "none", "null", "unknown", "tbd",
    "test", "temp", "pending", "not available", "not applicable",
    "unspecified", "unassigned", "no name", "no company", "-", "--", ".",
    "various", "other", "misc", "general", "private", "individual",
)
TITLE_LOWER_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "by", "of")
TITLE_UPPER_WORDS = (
    "USA", "US", "UK", "LLC", "LLP", "IBM", "GE", "GM", "HP", "IT", "AI", "ABB", "PPG", "ADM",
    "BMX", "BMS", "BD", "EOG", "XTO", "BHP", "FMC", "RPM", "SPX", "SKF", "USG", "CRH", "BRP",
    "JBS", "GSK", "RTX",
)

TRAILING_SUFFIX_PATTERN = (
    r",?\s+\b(INC\.?|INCORPORATED|LLC|L\.L\.C\.?|LTD\.?|LIMITED|CORP\.?|CORPORATION|CO\.?|COMPANY"
    r"|L\.?P\.?|GROUP|HOLDINGS?)$"
)
CORPORATE_PATTERN = (
    r",?\s*\b(INC\.?|INCORPORATED|LLC|L\.?L\.?C\.?|LTD\.?|LIMITED|CORP\.?|CORPORATION|CO\.?|COMPANY"
    r"|L\.?P\.?|HOLDINGS?|ENTERPRISES?|INDUSTRIES?\b|INTERNATIONAL|MANUFACTURING|MFG\.?)\s*$"
)
FIRST_SUFFIX_PATTERN = (
    r"\b(INC\.?|INCORPORATED|LLC|L\.?L\.?C\.?|LTD\.?|LIMITED|CORP\.?|CORPORATION|CO\.?|COMPANY|L\.?P\.?)\b"
)
NON_COMPANY_PATTERN = (
    r"\b(?:COUNTY|CITY\s+OF|STATE\s+OF|DEPT\s+OF|DEPARTMENT|UNIVERSITY|SCHOOL|DISTRICT|MUNICIPAL|BOROUGH"
    r"|TOWNSHIP|VILLAGE\s+OF|BUREAU|COMMISSION|AUTHORITY|AGENCY|COUNCIL|CHURCH|LIBRARY|HOSPITAL|CLINIC"
    r"|MEDICAL\s+CENTER|FIRE\s+DEPT|POLICE|SHERIFF|COURT)\b"
)
EQUIPMENT_PATTERN = (
    r"\b(\d{3,4}\s*HP|G\d{3,4}|C-?\d{1,2}\b|3\d{3}|D-?\d{2}|NO\d{3,4}|SN\s*[A-Z0-9]|UNIT\s*#|PORTABLE"
    r"|GENERAT|COMPRESSOR|ENGINE\b|FLEET\b|\d+\s*EA\.?\s)"
)
DASH_SEPARATORS = (" - ", " – ", " — ")
SOFT_SEPARATORS = (" / ", ", ")
EXTRA_SEPARATORS = (" - ", " – ", " — ", " / ", ", ", " @ ")
DIVISION_OF_PATTERN = r"\b(?:DIVISION|SUBSIDIARY|UNIT|BRANCH|DEPT)\s+OF\s+(.+)$"
A_DIVISION_OF_PATTERN = r"^(.+?)\s+(?:A\s+)?(?:DIVISION|SUBSIDIARY)\s+OF"
DBA_PATTERN = r"\bDBA\s+(.+)$"
HASH_PATTERN = r"^(.+?)\s+#\d+"
TRAILER_PATTERN = (
    r"\s+(?:PLANT|FACILITY|FACTORY|WORKS|MILL|MINE|QUARRY|PIT|TERMINAL|WAREHOUSE|DIST(?:RIBUTION)?\s+CENTER"
    r"|SHOP|YARD|DEPOT|STATION|REFINERY|SMELTER|FOUNDRY|FORGE|DIVISION|DIV)\s*(?:#?\d+)?$"
)
HYPHEN_PATTERN = r"^([A-Z][A-Za-z]{2,}(?:\s+[A-Za-z]+)*)-([A-Z][A-Za-z]{2,}.*)$"
INDUSTRY_TERM_PATTERN = (
    r"\b(?:STEEL|METALS?|IRON|ALUMINUM|PLASTICS?|RUBBER|GLASS|CHEMICAL|LUMBER|TIMBER|CONCRETE|CEMENT|ASPHALT"
    r"|PAVING|ROOFING|INSULATION|PACKAGING|PRINTING|MACHINING|WELDING|FOUNDRY|FABRICAT\w*|TOOL|DIE|MOLD"
    r"|STAMPING|CASTING|FORGING|PLATING|COATING|FINISHING|ASSEMBLY|MANUFACTURING|MFG|PRODUCTS?"
    r"|TECHNOLOGIES|SOLUTIONS|SYSTEMS|SERVICES|SUPPLY|SUPPLIES|COMPONENTS?|PARTS|EQUIPMENT|MACHINERY"
    r"|ELECTRONICS?|AEROSPACE|AUTOMOTIVE|MARINE|AVIATION|DEFENSE|ENERGY|POWER|SOLAR)\s*$"
)
TICKER_STRIP_PATTERN = r"[,.]|\s+(INC|CORP|CO|LTD|LLC|LP|PLC|NV|SA|AG|SE|HOLDINGS?)\.?$"
COMPANY_STRIP_PATTERN = r"[,.]|\s+(INC|CORP|CO|LTD|LLC|LP)\.?$"

# --- Fixed values: clean-up of company rows --------------------------------------------------

SHORT_NAMES_KEPT = ("3M", "GE", "BD", "HP", "GM", "BP", "LG", "ZF", "IT", "US", "K2")
GARBAGE_NAMES = ("Air", "Pq", "Na", "N/A", "Tbd", "Unknown", "None", "Test", "Null")
UNLINK_NAMES = (
    "Na", "N/A", "Tbd", "Unknown", "None", "Test", "Null", "Various", "Other", "Private", "-", ".",
)

# --- Fixed values: equipment and infrastructure names ----------------------------------------

PORTABLE_PATTERN = r"\bPORTABLE\b"
EQUIPMENT_WORDS_PATTERN = r"\b(GENERATOR|ENGINE|COMPRESSOR|PUMP|BOILER|TURBINE|GENSET|CHILLER)\b"
EQUIPMENT_SHARE_PATTERN = r"\b(PORTABLE|GENERATOR|ENGINE|COMPRESSOR|PUMP|BOILER|TURBINE|GENSET)\b"
BROAD_EQUIPMENT_PATTERN = (
    r"\b(PORTABLE|GENERATOR|ENGINE NO|COMPRESSOR STATION|PUMP STATION|BOILER|TURBINE|GENSET|WELLHEAD|WELL PAD"
    r"|TANK BATTERY|FLARE|VENT|METER STATION|PIPELINE|LINE\s+\d|MP\s+\d)\b"
)
RAW_EQUIPMENT_PATTERN = (
    r"\b(GENERATOR|ENGINE|COMPRESSOR|PUMP STATION|BOILER|TURBINE|GENSET|WELLHEAD|WELL PAD|TANK BATTERY|PIPELINE)\b"
)
INFRASTRUCTURE_PATTERN = (
    r"\b(PORTABLE|GENERATOR|COMPRESSOR STATION|PUMP STATION|WELLHEAD|WELL PAD|TANK BATTERY|PIPELINE"
    r"|METER STATION|GAS PLANT|OIL FIELD|DRILL|FLARE)\b"
)
OIL_GAS_PHRASES = (
    "COMPRESSOR STATION", "PUMP STATION", "WELLHEAD", "WELL PAD", "TANK BATTERY", "GAS PLANT",
    "OIL FIELD", "PIPELINE", "METER STATION", "FLARE", "SEPARATOR",
)
NON_SITE_CITIES = ("PORTABLE SOURCE", "STATEWIDE")
MODEL_NUMBER_PATTERN = (
    r"\b(G\d{3,4}|C-?\d{1,2}\b|3\d{3}|D-?\d{1,2}\b|\d{3,4}\s*HP|\bSN\b|NO\d{3,4}|PORTABLE SOURCE|STATEWIDE)"
)
UNIT_REGISTRATION_PATTERNS = (
    r"^\d{3,4}\s*HP\b", r"\bSN\s*[A-Z0-9]{5,}\b", r"\bNO\d{4}\b", r"\bUNIT\s*#\d+",
)
MISATTRIBUTED_MODEL_PATTERNS = (
    r"\bG\d{3,4}\b", r"\b3\d{3}\b", r"\bD-?\d{2}\b", r"\d{3,4}\s*HP\b", r"\bSN\s*[A-Z0-9]",
    r"\bNO\d{3,4}\b", r"\bUNIT\s*#",
)
CROSS_BRANDS = ("CATERPILLAR", "CUMMINS", "WAUKESHA", "JOHN DEERE")
MISATTRIBUTED_BRANDS = ("CATERPILLAR", "CUMMINS", "WAUKESHA", "JOHN DEERE", "KOHLER", "GENERAC")
MISATTRIBUTED_COMPANIES = ("Caterpillar", "Cummins", "John Deere", "Kohler", "Generac")

# --- Fixed values: classes of unlinked names, first match wins --------------------------------

UNLINKED_CLASSES = (
    ("government", r"^(CITY OF |VILLAGE OF |TOWN OF |PORT OF |COUNTY OF )"),
    ("government", r"^(US |U\.S\. |US NAVY|US ARMY|CALTRANS|WA DOT)"),
    ("has_facility_suffix", r"(PLANT|FACILITY|FACTORY|WORKS|MILL|REFINERY|TERMINAL)\s*#?\d*$"),
    ("has_number", r"#\d+"),
    ("has_corporate_suffix", r"(INC|LLC|CORP|LTD|CO)\.?\s*$"),
    ("initial_ampersand", r"^[A-Z] & [A-Z]"),
)
VERY_SHORT_NAME = 10

# --- Fixed values: address stubs -------------------------------------------------------------

STUB_STREET_WORDS = (
    "AVENUE", "AVE", "STREET", "ST", "ROAD", "RD", "DRIVE", "DR", "LANE", "LN", "WAY", "BLVD", "BOULEVARD",
    "COURT", "CT", "CIRCLE", "CIR", "CRESCENT", "PLACE", "PL", "PARKWAY", "PKWY", "TERRACE", "TRAIL",
    "HIGHWAY", "HWY", "ROUTE", "RTE", "SQUARE", "SQ", "MEWS", "POINT", "PT", "ALLEY", "WALK", "ROW", "LOOP",
    "RUN", "PASS", "CROSSING", "PLAZA",
)
STUB_REAL_ESTATE_WORDS = (
    "ASSOCIATES", "ASSOCIATION", "PARTNERS", "PARTNERSHIP", "VENTURES", "VENTURE", "INVESTORS", "INVESTMENT",
    "INVESTMENTS", "HOLDINGS", "PROPERTIES", "PROPERTY", "REALTY", "REAL ESTATE", "OWNER", "OWNERS",
    "TENANTS", "LANDLORD", "LESSOR",
)
STUB_SUFFIXES = r"LLC|L\.L\.C\.|INC|INC\.|CORP|CORP\.|CORPORATION|LP|L\.P\.|LTD|LIMITED|CO\.?|COMPANY"

_STREET = "|".join(STUB_STREET_WORDS)
_ESTATE = "|".join(STUB_REAL_ESTATE_WORDS)
_SUFFIX = STUB_SUFFIXES

STUB_PATTERNS = (
    r"\bPROPERTY\s+(OWNER|OWNR|HOLDER)S?\b",
    r"^\d+\s+.+@",
    rf"^\d{{3,}}\s+.*\b({_STREET})\b",
    rf"^\d{{3,}}\s+.*\b({_ESTATE})\b",
    rf"^\d{{3,}}\s+[A-Za-z][A-Za-z0-9 .,'&/-]{{0,40}}\s+({_SUFFIX})([-\s][A-Za-z0-9]+)*\s*$",
    rf"^\d+\s*[xX×]\s*\d+\s+.*\b({_ESTATE})\b",
    r"\bCITY OF [A-Z]+\s+FLEET\s+(MGMT|MANAGEMENT)\b",
    r"\bGRAVEL\s+(DRIVEWAY|YARD|LOT|PIT)\b",
    rf"^\d{{2,}}(\s+\d+)*\s+({_SUFFIX})\s*$",
    rf"^\d{{1,4}}(ST|ND|RD|TH)\s+([A-Z][A-Za-z]*\s+){{0,2}}({_STREET})\b",
    rf"^\d+[/\\-]\d+.*\b({_SUFFIX})\b",
    r"^\(FORMER\b",
    r"(^|\s)FORMER\s*$",
    r"\(FORMER\)\s*$",
    r"-\s*(COMPLAINT|INCIDENT|RESPONSE|INVESTIGATION|CLAIM|VIOLATION)\s*$",
    r"^\d+[\s-]*(TPH|T\.P\.H\.)\b",
    r"\bGCP\d+-\d+",
    r"^\d+-\d+\s+ASPHALT\s+MIXING\s+PLANT",
    r"^\d+\s+TIRE\s+(SYSTEMS|SERVICES|CENTER|CO|INC|LLC|SHOP)\b",
    r"\bTRUCK\s+PARTS\s+(INC|LLC|CORP|CO)\b",
    r"^#\d+\s*[-–]\s*[A-Z]",
    r"^#\d+\s*$",
    r"^\d{1,3}\s*$",
    r"\b(AZ|CA|TX|FL|NY|IL|OH|GA|WA|OR|CO|PA|MI|NJ|VA|NC)\s+DOT\b",
    rf"^\d{{1,2}}\s+[A-Za-z][A-Za-z .,'&/-]{{0,40}}\b({_ESTATE})\b",
    r"^\d+\s*,?\s*(LLC|L\.L\.C\.|INC|INC\.|CORP|CORP\.|LP|L\.P\.|LTD)\.?\s*$",
    r"\((VES|STRIPPER|TANK|GENSET|TOWER|KILN|BOILER|FURNACE|INCINERATOR|SCRUBBER|REACTOR|RTO|FGD|ESP|SCR"
    r"|DRUM|BAGHOUSE|FLARE)[\s/0-9]*[^)]*\)\s*$",
    r"\bLANDFILL\s*$",
    r"\b(WASTEWATER\s+TREATMENT|WASTEWATER\s+PLANT|WWTP|WASTE\s+TREATMENT\s+(PLANT|FACILITY))\b",
    r",\s*(CITY|TOWN|VILLAGE|BOROUGH|TOWNSHIP)\s+OF\s*$",
    r"^COUNTY\s+OF\s+[A-Z]",
    r"^(U\.?S\.?\s+)?(NATIONAL GUARD|US NAVY|US AIR FORCE|US ARMY)\s+-\s*",
    r"\b(RECREATION CENTER|COMMUNITY CENTER|SENIOR CENTER|PUBLIC HOUSING|HOUSING AUTHORITY)\b",
    r"\bWASTE\s+(SYSTEMS|SERVICES|MANAGEMENT|MGT|MGMT|INDUSTRIES)\s+OF\b",
    r"^(BFI|WM|ALLIED|REPUBLIC|WASTE MANAGEMENT)\s+.*\bWASTE\b",
    r"\bAUTO\s+(REPAIR|BODY|REPAIRING|SALES|SVC|DEALER|DEALERSHIP|DETAIL|TIRE|GLASS)\b",
    r"\b(TRUCK|AUTO)\s+REPAIR\b",
    r"\b(TRUCKING|HAULING|FREIGHT)\s+(CO|CORP|INC|LLC|LTD|SERVICES?|LINE|LINES)\b",
    r"\b(GAS|SERVICE|FUEL)\s+STATION\b",
    r"\b(FUEL\s+(STOP|MART)|TRUCK\s+STOP|CAR\s+WASH|TRAVEL\s+(CENTER|CENTRE))\b",
    r"\b(DRY\s+CLEAN|DRY\s+CLEANERS|LAUNDRY)\s+(CO|LLC|INC|SERVICES?)\b",
    r"\b(SELF|MINI|PUBLIC)\s+STORAGE\b",
    r"\bRECYCLING\s+(CENTER|INC|CORP|LLC)\b",
    r"\b(DISPOSAL|SALVAGE|JUNK|LANDFILL)\s+(CO|CORP|INC|LLC|SERVICES?)\b",
    r"\b(PAINTING|LANDSCAPING|PAVING|EXCAVATING|EXCAVATION)\s+(CONTRACTOR|CONTRACTORS|CO|CORP|INC|LLC|SERVICES?)\b",
    r"\bASPHALT\s+CONTRACTORS\b",
    r"\b(RENTAL|RENTALS|LEASING)\s+(CO|CORP|INC|LLC|SERVICES?)\b",
    r"\b(FORMER|CLOSED|ABANDONED|DEFUNCT|DEMOLISHED)\s+(FACILITY|PLANT|SITE|LOCATION|OPERATION)\b",
    r"-\s*FORMER\s+SITE\s+OF\b",
    r"\bMOBIL\s+(SERVICE|STATION)\b",
    r"\b(DAY\s+PARTS)\s+(INC|CORP|LLC|CO)\b",
    r"\bTRUCKING\b",
    r"\bHAULING\b",
    r"\bPEST\s+CONTROL\b",
    r"\bELEVATOR\s+SERVICE\b",
    r"\bRAIL\s+SERVICE\b",
    r"\bSEALING\s+SERVICES?\b",
    r"\bJANITORIAL\s+(SERVICE|SERVICES|CO|INC|LLC)\b",
    r"\bEXTERMINATOR\b",
    r"\bLAWN\s+CARE\b",
    r"\bSECURITY\s+(SERVICE|SERVICES|GUARD)\b",
    r"\b(FENCE|FENCING)\s+(CO|CORP|INC|LLC)\b",
    r"\bCATERING\s+(CO|INC|LLC|SERVICE)\b",
)
# Names with these are kept whatever the patterns above say
STUB_KEEP_PREFIX_PATTERN = r"^\d+\s*-\s*[A-Z]"
STUB_KEEP_DBA_PATTERN = r"\bDBA\b"
