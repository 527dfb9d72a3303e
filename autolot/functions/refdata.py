"""Constant tables. The values are fixed by the data model; results depend on them."""

# Label fuel codes.
FUEL_CODES = {
    "ES": "essence", "GO": "diesel", "EH": "hybride", "GH": "hybride", "EE": "hybride_rechargeable", "GE": "hybride_rechargeable",
    "EL": "electrique", "GL": "hybride_rechargeable", "GP": "gpl", "GN": "gnv", "ES/GP": "gpl", "ES/GN": "gnv", "GO/GN": "gnv",
    "FE": "ethanol", "FG": "superethanol", "ESSENCE": "essence", "DIESEL": "diesel", "GAZOLE": "diesel", "ELECTRIQUE": "electrique",
    "ELECTRIC": "electrique", "ÉLECTRIQUE": "electrique", "HYBRIDE": "hybride", "HYBRIDE RECHARGEABLE": "hybride_rechargeable",
    "HYBRIDE ELECTRIQUE": "hybride", "HYBRIDE ÉLECTRIQUE": "hybride", "GPL": "gpl", "GNV": "gnv", "GAZ NATUREL": "gnv",
    "ETHANOL": "ethanol", "E85": "ethanol", "SUPERETHANOL": "superethanol", "GAZ+ELEC HNR": "hybride", "ESS+ELEC HNR": "hybride",
    "ELEC+ESSENC HR": "hybride_rechargeable", "ELEC+GAZOLE HR": "hybride_rechargeable", "ESS+G.P.L.": "gpl",
}

# Aliases of normalised brand names.
BRAND_ALIASES = {"b m w": "bmw", "mercedes benz": "mercedes", "vw": "volkswagen"}

# Brands in titles, in order of priority.
BRANDS = {
    "peugeot": ["peugeot", "peugeo"], "renault": ["renault", "renaul"], "citroen": ["citroen", "citroën"], "volkswagen": ["volkswagen", "vw", "volks"],
    "audi": ["audi"], "bmw": ["bmw"], "mercedes": ["mercedes", "mercedes-benz", "mb"], "toyota": ["toyota"], "ford": ["ford"], "opel": ["opel"],
    "fiat": ["fiat"], "nissan": ["nissan"], "hyundai": ["hyundai"], "kia": ["kia"], "seat": ["seat"], "skoda": ["skoda", "škoda"], "dacia": ["dacia"],
    "mini": ["mini"], "volvo": ["volvo"], "mazda": ["mazda"], "honda": ["honda"], "suzuki": ["suzuki"], "jeep": ["jeep"],
    "land rover": ["land rover", "landrover"], "jaguar": ["jaguar"], "porsche": ["porsche"], "tesla": ["tesla"], "lexus": ["lexus"],
    "alfa romeo": ["alfa romeo", "alfa"], "ds": ["ds automobiles", "ds"],
}

# Gearbox words.
GEARBOX_WORDS = {
    "automatique": ["automatique", "auto", "bva", "bva6", "bva7", "bva8", "dsg", "dct", "dkg", "s-tronic", "stronic", "tiptronic", "eat6", "eat8", "edc", "edg", "cvt", "e-cvt", "powershift", "speedshift", "quickshift", "robotisée", "robotisee", "pilotée", "pilotee", "aisin", "at"],
    "manuelle": ["manuelle", "manuel", "bvm", "bvm5", "bvm6", "mécanique", "mecanique", "5 vitesses", "6 vitesses", "5v", "6v", "mt"],
}

# Fuel words, in order of priority.
FUEL_WORDS = {
    "electrique": ["électrique", "electrique", "electric", "ev", "bev", "100% électrique", "100% electrique", "full electric", "e-208", "e-2008", "e-c4", "e-tron", "id.3", "id.4", "zoe", "leaf", "model 3", "model s", "model x", "model y", "kona ev", "niro ev", "ioniq", "mach-e"],
    "hybride_rechargeable": ["hybride rechargeable", "plug-in", "plugin", "phev", "rechargeable", "plug in hybrid", "t8", "p400e", "330e", "530e", "gla 250e"],
    "hybride": ["hybride", "hybrid", "hev", "mhev", "mild hybrid", "micro-hybride", "micro hybride", "e-tech", "etech"],
    "gnv": ["gnv", "cng", "gaz naturel", "tgi"],
    "gpl": ["gpl", "lpg", "bifuel", "bi-fuel"],
    "diesel": ["diesel", "gazole", "gasoil", "hdi", "bluehdi", "blue hdi", "blue-hdi", "tdi", "dci", "cdti", "crdi", "dtec", "d4d", "jtd", "jtdm", "mjt", "mjtd", "multijet", "tdci", "ddis", "i-dtec", "skyactiv-d",
               "116d", "118d", "120d", "125d", "216d", "218d", "220d", "225d", "316d", "318d", "320d", "325d", "330d", "335d", "340d", "418d", "420d", "425d", "430d", "435d", "440d", "518d", "520d", "525d", "530d", "535d", "540d", "630d", "640d", "725d", "730d", "740d", "750d",
               "x1 18d", "x1 20d", "x2 18d", "x2 20d", "x3 20d", "x3 30d", "x4 20d", "x4 30d", "x5 25d", "x5 30d", "x5 40d", "x6 30d", "x6 40d", "180d", "200d", "250d", "300d", "350d", "400d"],
    "essence": ["essence", "sp95", "sp98", "sans plomb", "e10", "e85", "tce", "puretech", "thp", "vti", "vvt", "vvti", "tfsi", "tsi", "fsi", "gti", "turbo essence", "mpi", "mivec", "vtec", "i-vtec", "skyactiv-g", "ecoboost", "ecotec", "duratec", "zetec"],
}

# Power and year patterns.
POWER_PATTERNS = [r"\b(\d{2,3})\s*(?:ch|cv|hp|din)\b", r"\b(\d{2,3})\s*chevaux\b", r"\bdin\s*(\d{2,3})\b", r"\b(?:hdi|tdi|dci|tce|puretech|thp|vti|e-hdi|blue\s*hdi|bluehdi)\s*(\d{2,3})\b"]
YEAR_PATTERN = r"\b(20[0-2][0-9])\b"

# Documented engine risks: key, severity, first year, year after the last.
RISKS = [
    ("peugeot_1.2_puretech_eb2", "high", 2014, 2020), ("peugeot_2.0_hdi_dw10", "medium", 2006, 2014), ("renault_1.2_tce_h5ft", "high", 2012, 2018),
    ("renault_1.5_dci_k9k", "low", 2005, 2020), ("bmw_n47_diesel", "critical", 2007, 2014), ("vw_1.4_tsi_ea111", "medium", 2006, 2013), ("ford_1.0_ecoboost", "high", 2012, 2019),
]
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
SEVERITY_MALUS = {"low": -0.5, "medium": -1.5, "high": -2.5, "critical": -4.0}

# Recall words by severity, and words of the penalty score.
RECALL_CRITICAL = ["incendie", "feu", "explosion", "mort", "décès", "fatal", "blessure grave", "accident grave", "perte de contrôle", "défaillance frein", "airbag", "ceinture sécurité"]
RECALL_SERIOUS = ["blessure", "accident", "défaillance", "rupture", "direction", "suspension", "électrique", "court-circuit"]
RECALL_PENALTY = ["frein", "airbag", "direction", "incendie", "feu", "ceinture"]

# Fuel prices, default consumption, station names and default station prices.
FUEL_PRICES = {"essence": 1.75, "diesel": 1.65, "superethanol": 0.85, "gpl": 0.95, "gnv": 1.20, "hybride": 1.75, "hybride_rechargeable": 1.75, "electrique": 0.22}
DEFAULT_CONSUMPTION = {"essence": 7.0, "diesel": 5.5, "hybride": 5.0, "hybride_rechargeable": 2.5, "electrique": 17.0, "superethanol": 8.5, "gpl": 9.0}
STATION_NAMES = {"essence": ["SP95", "SP98", "E10"], "diesel": ["Gazole"], "e85": ["E85"], "gpl": ["GPLc"]}
STATION_DEFAULTS = {"essence": 1.75, "diesel": 1.65, "e85": 0.85, "gpl": 0.95, "electrique": 0.25}
MAINTENANCE_PER_KM = 0.093

# Reputation (reliability, comfort, budget, safety, roominess) and estimate adjustments by brand.
REPUTATIONS = {
    "toyota": (8.5, 7.0, 7.5, 8.0, 7.0), "honda": (8.0, 7.0, 7.0, 7.5, 6.5), "mazda": (7.5, 7.5, 7.0, 7.5, 6.5), "lexus": (9.0, 8.5, 5.0, 9.0, 7.5),
    "dacia": (6.5, 5.5, 9.0, 6.0, 7.0), "renault": (5.5, 7.0, 7.0, 7.0, 7.0), "peugeot": (5.5, 7.5, 6.5, 7.5, 7.0), "citroen": (5.0, 7.5, 6.5, 7.0, 7.5),
    "volkswagen": (6.0, 8.0, 5.5, 8.0, 7.5), "audi": (6.0, 8.5, 4.5, 8.5, 7.0), "bmw": (5.5, 8.5, 4.0, 8.5, 7.0), "mercedes": (6.0, 9.0, 4.0, 9.0, 7.5),
    "hyundai": (7.0, 7.0, 8.0, 7.5, 7.5), "kia": (7.0, 7.0, 8.0, 7.5, 7.5), "skoda": (6.5, 7.5, 7.5, 7.5, 8.0), "seat": (6.0, 7.0, 7.0, 7.5, 7.0),
    "fiat": (5.0, 6.5, 7.5, 6.5, 6.5), "nissan": (6.5, 7.0, 7.0, 7.0, 7.0), "ford": (6.0, 7.0, 7.0, 7.5, 7.0), "opel": (6.0, 7.0, 7.0, 7.0, 7.5),
    "mini": (5.0, 7.5, 5.0, 7.0, 5.0), "tesla": (5.5, 8.0, 6.0, 9.0, 7.0), "volvo": (7.0, 8.5, 5.0, 9.5, 7.5),
}
DEFAULT_REPUTATION = (6.0, 6.0, 6.0, 6.5, 6.5)
#: Reliability, comfort, handling, roominess, finish; added to 7.
ESTIMATE_ADJUSTMENTS = {
    "toyota": (1.5, 0.5, 0.0, 0.0, 0.0), "lexus": (2.0, 1.5, 0.0, 0.0, 1.5), "mercedes": (0.0, 1.0, 0.0, 0.0, 1.0), "bmw": (0.0, 0.0, 1.0, 0.0, 0.5),
    "audi": (0.0, 0.5, 0.0, 0.0, 1.0), "porsche": (0.0, 0.0, 1.5, 0.0, 1.0), "volvo": (0.5, 1.0, 0.0, 0.0, 0.0), "honda": (1.0, 0.0, 0.0, 0.0, 0.0),
    "mazda": (0.5, 0.0, 0.5, 0.0, 0.0), "peugeot": (0.0, 0.0, 0.5, 0.0, 0.0), "renault": (0.0, 0.0, 0.0, 0.5, 0.0), "dacia": (0.5, -0.5, 0.0, 0.0, -1.0),
    "fiat": (-0.5, 0.0, 0.0, 0.0, 0.0), "alfa romeo": (-0.5, 0.0, 1.0, 0.0, 0.5),
}

# Aliases of market segments, power references (good, excellent), consumption references (excellent, fair, bad), value left by age.
SEGMENT_ALIASES = {
    "Volume + Premium": "Volume", "Volume + Premium (508/3008+)": "Volume", "Volume Premium": "Volume", "Volume (value-for-money)": "Volume", "Volume AWD": "Volume", "Volume SUV": "Volume",
    "Premium Sport": "Luxury_Sport", "Premium Electric": "Electric_First", "Premium SUV": "Premium", "Premium Small": "Premium", "Luxury": "Premium", "Luxury Sport": "Luxury_Sport",
    "Luxury/Sport": "Luxury_Sport", "Budget Volume": "Budget", "Budget Electric": "Electric_First", "SUV": "Volume", "SUV_Specialist": "Volume",
}
POWER_REFERENCES = {"Budget": (90, 110), "Volume": (130, 180), "Premium": (180, 250), "Luxury_Sport": (300, 450), "Electric_First": (300, 450)}
CONSUMPTION_REFERENCES = {"essence": (5.0, 7.0, 9.0), "diesel": (4.5, 6.0, 8.0), "hybride": (4.0, 5.5, 7.0), "electrique": (14.0, 17.0, 22.0)}
VALUE_BY_AGE = [0.95, 0.80, 0.70, 0.60, 0.52, 0.45, 0.40, 0.35]
CATEGORIES = [
    ("A", ["108", "c1", "up", "twingo", "aygo"]), ("B", ["208", "clio", "polo", "ibiza", "corsa", "fiesta"]), ("B-SUV", ["2008", "captur", "t-cross", "juke", "mokka"]),
    ("C", ["308", "golf", "leon", "focus", "megane", "astra"]), ("C-SUV", ["3008", "tiguan", "tucson", "qashqai", "kadjar"]), ("D", ["508", "passat", "talisman", "mondeo", "mazda6"]), ("D-SUV", ["5008", "touareg", "sorento", "kodiaq"]),
]
COMFORT_WORDS = ["confort", "silenc", "suspens", "insonori", "espace", "habitab"]
DYNAMIC_WORDS = ["dynamique", "agil", "tenue de route", "direction", "frein", "accélérat"]
SAFETY_WORDS = ["sécurité", "airbag", "assist", "freinage", "ada", "ncap", "étoiles"]

# Rating labels, fault classes, stop words.
CRITERIA = {
    "fiabilité": "fiabilite", "fiabilite": "fiabilite", "qualité / prix": "rapport_qualite_prix", "qualite / prix": "rapport_qualite_prix",
    "agrément de conduite": "comportement_routier", "agrement de conduite": "comportement_routier", "comportement routier": "comportement_routier",
    "confort": "confort", "équipement": "equipement", "equipement": "equipement", "finition": "qualite_finition", "qualité de finition": "qualite_finition",
    "habitabilité": "habitabilite_interieur", "habitabilite": "habitabilite_interieur", "volume de coffre": "habitabilite_interieur",
}
FAULT_CLASSES = [
    ("moteur", ["moteur", "engine", "turbo", "injection", "courroie", "distribution", "puretech", "tce", "dci"]),
    ("boite", ["boîte", "boite", "bva", "embrayage", "clutch", "transmission", "eat", "dct"]),
    ("electronique", ["électronique", "electronique", "capteur", "sensor", "écran", "gps", "multimedia", "batterie", "bsi"]),
    ("suspension", ["suspension", "amortisseur", "silent", "bloc", "triangle", "rotule"]),
    ("freinage", ["frein", "brake", "plaquette", "disque"]),
]
STOP_WORDS = ["le", "la", "les", "un", "une", "des", "de", "du", "à", "au", "aux", "et", "ou", "mais", "car", "donc", "or", "ni", "que", "qui", "quoi", "ce", "cette", "ces", "son", "sa", "ses", "mon", "ma", "mes", "très", "peu", "trop", "assez", "bien", "bon", "bonne", "est", "sont", "a", "ont", "fait", "être", "avoir"]

#: Brands looked for in the names of recalled products, in this order. Fixed values.
RECALL_BRANDS = ["PEUGEOT", "RENAULT", "CITROEN", "CITROËN", "VOLKSWAGEN", "VW", "BMW", "MERCEDES", "AUDI", "TOYOTA", "FORD", "OPEL", "FIAT", "NISSAN", "HYUNDAI", "KIA", "SEAT", "SKODA", "DACIA", "MINI", "VOLVO", "MAZDA", "HONDA", "SUZUKI", "JEEP", "LAND ROVER", "JAGUAR", "PORSCHE", "TESLA", "ALFA ROMEO", "DS"]

# Limits of rows, required ones, and enumerations.
NAME_LENGTHS = {"marque": 50, "modele": 100, "motorisation": 100}
VEHICLE_RANGES = {"puissance": (50, 1500), "annee_debut": (1990, 2030), "annee_fin": (1990, 2030), "co2": (0, 500), "conso": (0, 30)}
REQUIRED = ["puissance", "annee_debut"]
LISTING_RANGES = {"year": (1990, 2030), "expert": (0, 20), "deal": (-100, 100)}
FUELS = ["essence", "diesel", "hybride", "hybride_rechargeable", "electrique", "gpl", "gnv", "inconnu"]
GEARBOXES = ["manuelle", "automatique", "inconnu"]

# Insurance a year (fixed part, part of each fiscal horsepower) and upkeep a kilometre, by profile.
INSURANCE = {"citadine": (380, 35), "berline": (480, 40), "suv": (550, 45)}
UPKEEP_PER_KM = {"citadine": 0.084, "berline": 0.092, "suv": 0.105}
