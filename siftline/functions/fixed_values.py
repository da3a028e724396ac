"""Fixed values.

Everything in this module is data that decides results: word lists, patterns and thresholds whose
exact spelling and order matter. They are defaults of function arguments, never read implicitly
from inside an expression, so a caller can pass other lists.
"""

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"

# ---- language gate ---------------------------------------------------------------------------
# Language -> names it is written as (accents already stripped).
LANGUAGE_NAMES = {
    "german": ("german", "deutsch"),
    "hungarian": ("hungarian", "magyar"),
    "spanish": ("spanish", "espanol", "castellano"),
    "french": ("french", "francais"),
    "italian": ("italian", "italiano"),
    "dutch": ("dutch", "nederlands"),
    "polish": ("polish", "polski"),
    "czech": ("czech", "cestina"),
    "portuguese": ("portuguese", "portugues"),
    "swedish": ("swedish", "svenska"),
    "danish": ("danish", "dansk"),
    "norwegian": ("norwegian", "norsk"),
    "finnish": ("finnish", "suomi"),
    "romanian": ("romanian", "romana"),
}

# Wording that makes a language a condition.
LANGUAGE_REQUIRED = (
    "required", "requirement", "require", "mandatory", "must have", "must speak",
    "very good", "excellent", "strong", "good command", "command of", "advanced",
    "working knowledge", "needed", "solid", "good knowledge", "sound knowledge",
    "fluent", "fluency", "native", "proficient", "proficiency", "business level",
    "business fluent", "c1", "c2", "b2", "verhandlungssicher", "essential",
    "is a must", "a must", "necessary", "obligatory", "compulsory",
)

# Wording that makes a language optional.
LANGUAGE_OPTIONAL = (
    "advantage", "advantageous", "plus", "nice to have", "nice-to-have",
    "preferred", "preferable", "preferably", "desirable", "desired", "beneficial",
    "bonus", "asset", "welcome", "appreciated", "ideally", "optional",
    "not required", "no need", "not necessary", "not mandatory", "would be great",
)

# Native-speaker demands that name no language.
NATIVE_SPEAKER_PATTERNS = (
    r"\bnative\s+(?:speaker|level|proficiency|fluency|command|tongue)\b",
    r"\bmother\s+tongue\b",
    r"\bmothertongue\b",
    r"\bnative\s+or\s+bilingual\b",
    r"\bmust\s+be\s+(?:a\s+)?native\b",
)

# What may stand between "english" and another language name.
LANGUAGE_JOINER = r"(?:\s+(?:and|&|/|or|plus|with))?\s+"

# Stopwords per language, in tie-break order.
LANGUAGE_STOPWORDS = {
    "italian": ("il", "la", "le", "dei", "delle", "della", "che", "con", "per", "una", "sono",
                "nostro", "azienda", "lavoro", "esperienza"),
    "german": ("und", "der", "die", "das", "mit", "fur", "von", "bei", "wir", "sie", "unser",
               "erfahrung", "kenntnisse", "aufgaben"),
    "spanish": ("los", "las", "para", "con", "que", "una", "nuestro", "empresa", "experiencia",
                "trabajo", "conocimientos", "de", "el", "y", "del", "es", "un", "en", "por", "su",
                "sus", "como", "muy", "tambien", "ademas", "desarrollo", "gestion"),
    "hungarian": ("es", "az", "egy", "hogy", "vagy", "nem", "munka", "tapasztalat", "feladatok",
                  "elvarasok", "cegunk", "csapat"),
    "french": ("les", "des", "pour", "avec", "que", "une", "notre", "entreprise", "experience",
               "travail", "connaissances"),
    "dutch": ("het", "van", "een", "voor", "met", "onze", "werk", "ervaring", "kennis", "wij"),
    "polish": ("na", "jest", "oraz", "nasza", "praca", "doswiadczenie", "wymagania"),
    "swedish": ("och", "att", "som", "med", "till", "av", "den", "det", "ett", "du", "vi", "har",
                "ar", "pa", "om", "eller", "inte", "vill", "vara", "samt", "erfarenhet", "arbeta",
                "kunskap", "soker", "meriterande", "krav", "tjanster", "verksamhet"),
    "danish": ("og", "til", "af", "er", "det", "ikke", "med", "som", "har", "vi", "du", "et", "pa",
               "om", "eller", "vores", "erfaring", "arbejde", "kendskab", "krav", "opgaver"),
    "norwegian": ("og", "til", "av", "er", "det", "ikke", "med", "som", "har", "vi", "du", "et",
                  "pa", "om", "eller", "vare", "erfaring", "arbeid", "kunnskap", "krav",
                  "oppgaver"),
    "finnish": ("ja", "ei", "etta", "tai", "kanssa", "seka", "meilla", "haemme", "kokemus",
                "kokemusta", "osaaminen", "tehtavat", "tyo"),
    "czech": ("je", "se", "pro", "ve", "nebo", "nase", "praxe", "znalost", "zkusenosti",
              "pozadujeme", "nabizime"),
    "portuguese": ("de", "para", "com", "que", "uma", "nossa", "empresa", "experiencia",
                   "trabalho", "conhecimentos", "voce", "da", "dos", "das", "nao", "sao", "mais",
                   "tambem", "em", "seu", "seus", "como", "desenvolvimento", "gestao"),
    "romanian": ("si", "pentru", "cu", "care", "este", "sau", "nostru", "experienta",
                 "cunostinte", "echipa", "cerinte"),
}
ENGLISH_STOPWORDS = (
    "the", "and", "of", "to", "in", "for", "with", "you", "our", "we", "is", "are", "will",
    "your", "a", "an", "as", "on", "be", "have", "this", "that", "or", "from", "at", "by", "not",
    "do", "it", "they", "their",
)

# Thresholds of the language detector.
DETECT_MIN_CHARS = 400
DETECT_MIN_RATIO = 0.06
DETECT_MIN_HITS = 8
DETECT_ENGLISH_MARGIN = 1.5
ENGLISH_MIN_RATIO = 0.06
ENGLISH_MIN_TOKENS = 60

# ---- sponsorship gate ------------------------------------------------------------------------
# Sentences that refuse sponsorship.
SPONSORSHIP_DENIED = (
    r"\bno\s+(?:visa\s+|work\s+|immigration\s+)*sponsorship\b",
    r"\bno\s+(?:visa|work\s+permit|immigration)\s+(?:support|assistance)\b",
    r"\b(?:do|does|will|can|could|shall)\s+not\s+sponsor\b",
    r"\bwon\s+t\s+sponsor\b",
    r"\bcan\s*not\s+sponsor\b",
    r"\bunable\s+to\s+(?:sponsor|offer\s+sponsorship|provide\s+sponsorship)\b",
    r"\bnot\s+(?:able|in\s+a\s+position)\s+to\s+(?:sponsor|offer|provide)\b",
    r"\bsponsorship\s+(?:is\s+|are\s+)?not\s+(?:provided|available|offered|possible|supported)\b",
    r"\bsponsorship\s+(?:cannot|can\s*not)\s+be\s+(?:offered|provided)\b",
    r"\bnot\s+(?:offer|provide|support)\w*\s+(?:any\s+)?(?:visa\s+|work\s+|immigration\s+)*sponsorship\b",
    r"\bwithout\s+(?:visa\s+|the\s+need\s+for\s+)*sponsorship\b",
    r"\bnot\s+eligible\s+for\s+(?:\w+\s+){0,3}sponsorship\b",
)

# Nationalities that can be demanded.
NATIONALITY = (
    r"(?:eu|eea|european|uk|british|us|usa|american|irish|swiss|german|austrian|dutch|belgian|"
    r"french|spanish|italian|hungarian|polish|czech|portuguese|finnish|swedish|danish|norwegian|"
    r"canadian|australian)"
)

# Sentences that demand papers; a negator just before pardons them.
AUTHORISATION_WALL = (
    rf"\b(?:hold|holding|possess|have)\s+(?:an?\s+|a\s+valid\s+)?{NATIONALITY}\s+passport\b",
    rf"\b{NATIONALITY}\s+passport\s+(?:is\s+)?(?:required|mandatory|essential|a\s+must)\b",
    rf"\bmust\s+be\s+(?:an?\s+)?{NATIONALITY}\s+(?:citizens?|nationals?)\b",
    rf"\b{NATIONALITY}\s+citizenship\s+(?:is\s+)?(?:required|mandatory|essential)\b",
    r"\bmust\s+be\s+a\s+(?:citizen|national)\s+of\b",
    r"\bonly\s+(?:\w+\s+)?(?:citizens|nationals|passport\s+holders)\b",
    rf"\bonly\s+{NATIONALITY}\s+(?:applicants|candidates|residents)\b",
    r"\b(?:must|should|need\s+to)\s+(?:already\s+)?(?:have|hold|possess)\s+"
    r"(?:the\s+|an?\s+|a\s+valid\s+|an?\s+existing\s+|unrestricted\s+)*(?:legal\s+)?right\s+to\s+work\b",
    r"\b(?:applicants|candidates|you)\s+must\s+(?:already\s+)?have\s+(?:the\s+)?right\s+to\s+work\b",
    r"\bright\s+to\s+work\s+in\s+[\w\s]{1,20}?\s+(?:is\s+)?(?:required|essential|mandatory)\b",
    r"\bmust\s+be\s+eligible\s+to\s+work\s+(?:in\s+[\w\s]{1,20}?\s+)?"
    r"without\s+(?:restriction|sponsorship|limitation)\b",
    r"\bmust\s+be\s+(?:legally\s+)?authoris\w*\s+to\s+work\b",
    r"\bmust\s+be\s+(?:legally\s+)?authoriz\w*\s+to\s+work\b",
    r"\bmust\s+(?:have|hold)\s+(?:a\s+|an?\s+|a\s+valid\s+)?work\s+(?:permit|visa|authoris\w+|authoriz\w+)\b",
    r"\b(?:a\s+|an\s+)?(?:valid\s+|current\s+)?work\s+(?:permit|visa|authoris\w+|authoriz\w+)\s+"
    r"(?:is\s+)?(?:required|mandatory|essential|a\s+must)\b",
    r"\bmust\s+have\s+unrestricted\s+work\s+authoris\w*\b",
    r"\bmust\s+have\s+unrestricted\s+work\s+authoriz\w*\b",
    r"\bmust\s+have\s+permanent\s+resid\w+\b",
)

# Words that turn a demand for papers around, and how far before it they count.
WALL_NEGATORS = ("no ", "not ", "without ", "dont ", "don t ", "doesn t ", "need not ",
                 "regardless of ", "irrespective of ")
WALL_NEGATOR_CHARS = 40

# Sentences that offer sponsorship.
SPONSORSHIP_OFFERED = (
    r"\b(?:we|company)\s+(?:can|will|do|may)\s+sponsor\b",
    r"\b(?:visa\s+)?sponsorship\s+(?:is\s+)?(?:available|provided|offered)\b",
    r"\bwe\s+(?:offer|provide)\s+(?:visa\s+)?sponsorship\b",
    r"\b(?:happy|open|willing)\s+to\s+sponsor\b",
    r"\b(?:happy|open|willing|able|prepared|glad)\s+to\s+(?:offer|provide|support|arrange)\s+"
    r"(?:visa\s+|work\s+|immigration\s+)*sponsorship\b",
    r"\bwe\s+(?:will|can|do)\s+(?:offer|provide|support|arrange)\s+"
    r"(?:visa\s+|work\s+|immigration\s+)*sponsorship\b",
    r"\bwill\s+consider\s+sponsorship\b",
    r"\brelocation\s+and\s+visa\s+support\b",
    r"\bvisa\s+sponsorship\s+for\s+the\s+right\s+candidate\b",
    r"\binternational\s+(?:applicants|candidates)\s+(?:are\s+)?welcome\b",
    r"\b(?:help|assist|support)\s+(?:you\s+|candidates\s+|with\s+)*(?:to\s+)?"
    r"(?:obtain|obtaining|apply|applying|secure|securing|arrange|arranging|get|getting)\s+"
    r"(?:a\s+|the\s+|your\s+)*(?:work\s+permit|work\s+visa|visa|residence\s+permit)\b",
)

# ---- experience gate -------------------------------------------------------------------------
# A years figure or range. Dashes are already folded to "-" in gate text.
YEARS = (r"(?<![0-9])(\d{1,2})\s*(?:\+|plus)?\s*"
         r"(?:(?:[-‐-―−－]|/|to|up to)\s*(\d{1,2})\s*(?:\+|plus)?\s*)?(?:year|yr)s?\b")
YEARS_MAX = 3
YEARS_BEFORE, YEARS_AFTER = 60, 45

# Wording around a years figure.
YEARS_AMBIGUOUS = (
    "+/-", "+-", "approximately", "approx", "around", "circa", "about", "ideally", "preferably",
    "preferred", "nice to have", "nice-to-have", "or equivalent", "equivalent experience",
    "comparable", "desirable", "advantage", "a plus", "is a plus", "bonus", "asset",
    "not required", "or more", "typically",
)
YEARS_DOMAIN_SCOPED = ("industry", "sector", "domain", "vertical")
YEARS_MANDATORY = (
    "required", "requirement", "must", "minimum", "min", "at least", "no less than", "we require",
    "you have", "you bring", "candidates must", "essential", "mandatory", "proven",
    "demonstrated", "solid", "experience", "background", "track record", "history of", "hands on",
    "hands-on",
)
YEARS_HARD_FLOOR = ("at least", "minimum", "no less than", "not less than")
YEARS_NOT_TENURE = (
    "years of age", "over the past", "in the last", "founded", "since", "for the past",
    "anniversary", "history", "contract", "fixed term", "fixed-term", "duration",
    "graduated within", "warranty", "years old",
)
YEARS_COMPANY_AGE = (
    "our company has", "the company has", "we have been", "we have over", "company was",
    "we celebrate", "celebrating", "we have grown", "has grown", "our journey",
    "in business for", "on the market for", "operating for",
)
YEARS_TENURE_OVERRIDE = (
    "proven history", "track record", "demonstrated history", "documented history",
    "history of delivering", "history of leading", "history of building",
)
YEARS_TENURE_PHRASE = (r"^\s*(?:in|of|within|as|leading|managing|working|supporting|driving|"
                       r"delivering|building)\b")

# ---- seniority gate --------------------------------------------------------------------------
# Grade words in a title, and nouns that make "lead" an ordinary noun.
SENIORITY_WORDS = ("senior", "sr", "snr", "lead", "leader", "principal", "head", "director",
                   "expert")
LEAD_FOLLOWERS = ("time", "times", "to", "generation", "gen", "management", "qualification",
                  "nurturing", "scoring", "conversion")

# ---- closed gate -----------------------------------------------------------------------------
# Notices that a posting is closed, and wording that only states a deadline.
CLOSED_NOTICES = (
    "no longer accepting applications", "no longer accepting application",
    "not accepting applications", "no longer available", "applications are closed",
    "applications closed", "application closed", "this job is closed", "this position is closed",
    "position has been filled", "position is filled", "role has been filled",
    "vacancy is closed", "vacancy has closed", "posting has expired", "posting expired",
    "job has expired", "expired job", "closed for applications", "applications have closed",
    "we are no longer accepting", "recruitment for this role has closed",
    "this advert has closed", "advert has expired",
)
CLOSED_DEADLINES = (
    "closes on", "close on", "closing date", "closes at", "closing on", "will close",
    "will be closed", "closes when", "close when", "closes once",
    "until the position is filled", "until filled", "before applications close", "apply before",
)

# ---- geography gate --------------------------------------------------------------------------
# Names that place a record outside Europe, in match order.
OUTSIDE_EUROPE = (
    "united states", "united states of america", "usa", "u s a",
    "north america", "latin america", "south america", "central america",
    "canada", "mexico", "brazil", "argentina", "chile", "colombia", "peru",
    "australia", "new zealand", "sydney", "melbourne", "auckland",
    "india", "bangalore", "bengaluru", "hyderabad", "mumbai", "delhi", "pune",
    "chennai", "gurgaon", "noida", "pakistan", "karachi", "lahore", "islamabad",
    "bangladesh", "sri lanka", "nepal",
    "china", "beijing", "shanghai", "shenzhen", "japan", "tokyo", "osaka",
    "south korea", "seoul", "taiwan", "taipei", "hong kong", "singapore",
    "malaysia", "kuala lumpur", "indonesia", "jakarta", "philippines", "manila",
    "vietnam", "hanoi", "thailand", "bangkok",
    "united arab emirates", "uae", "dubai", "abu dhabi", "qatar", "doha",
    "saudi arabia", "riyadh", "jeddah", "kuwait", "bahrain", "oman", "muscat",
    "israel", "tel aviv", "jerusalem",
    "south africa", "johannesburg", "cape town", "nigeria", "lagos", "kenya",
    "nairobi", "egypt", "cairo", "morocco", "ghana", "ethiopia", "tanzania",
    "us only", "usa only", "us based", "us-based", "united states only",
    "americas only", "north america only",
)

# Two-letter subdivisions of the US and Canada, valid only after a comma.
SUBDIVISIONS = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id",
    "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms",
    "mo", "mt", "ne", "nv", "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok",
    "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv",
    "wi", "wy", "dc",
    "ab", "bc", "mb", "nb", "nl", "ns", "nt", "nu", "on", "pe", "qc", "sk", "yt",
)

# US states without the names shared with a European place.
US_STATES = (
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado",
    "connecticut", "delaware", "florida", "hawaii", "idaho", "illinois",
    "indiana", "iowa", "kansas", "kentucky", "louisiana", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri",
    "montana", "nebraska", "nevada", "new hampshire", "new jersey",
    "new mexico", "new york", "north carolina", "north dakota", "ohio",
    "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina",
    "south dakota", "tennessee", "texas", "utah", "vermont", "virginia",
    "washington", "west virginia", "wisconsin", "wyoming",
)

# European countries, remote phrasings and cities, in match order.
INSIDE_EUROPE = (
    "albania", "andorra", "austria", "belarus", "belgium", "bosnia", "bulgaria",
    "croatia", "cyprus", "czech republic", "czechia", "denmark", "estonia",
    "finland", "france", "germany", "greece", "hungary", "iceland", "ireland",
    "italy", "kosovo", "latvia", "liechtenstein", "lithuania", "luxembourg",
    "malta", "moldova", "monaco", "montenegro", "netherlands", "holland",
    "north macedonia", "norway", "poland", "portugal", "romania", "san marino",
    "serbia", "slovakia", "slovenia", "spain", "sweden", "switzerland",
    "ukraine", "united kingdom", "great britain", "england", "scotland",
    "wales", "northern ireland",
    "europe", "european union", "european economic area", "eea",
    "remote eu", "eu remote", "eu only", "europe only", "eu-based", "eu based",
    "budapest", "debrecen", "szeged",
    "berlin", "munich", "muenchen", "hamburg", "frankfurt", "cologne", "koln",
    "stuttgart", "dusseldorf", "dortmund", "leipzig", "dresden", "nuremberg",
    "hannover", "bonn", "essen", "bremen", "karlsruhe", "mannheim",
    "vienna", "wien", "graz", "linz", "salzburg",
    "prague", "brno", "bratislava", "ljubljana", "zagreb", "belgrade",
    "warsaw", "krakow", "wroclaw", "gdansk", "poznan",
    "amsterdam", "rotterdam", "the hague", "eindhoven", "utrecht", "groningen",
    "brussels", "antwerp", "ghent", "leuven",
    "luxembourg city", "zurich", "geneva", "basel", "bern", "lausanne", "zug",
    "stockholm", "gothenburg", "goteborg", "malmo", "uppsala",
    "oslo", "bergen", "trondheim",
    "copenhagen", "aarhus", "odense", "aalborg",
    "helsinki", "espoo", "tampere", "vantaa", "oulu", "turku",
    "dublin", "cork", "galway", "limerick",
    "london", "manchester", "edinburgh", "glasgow", "bristol", "leeds",
    "liverpool", "sheffield", "nottingham", "belfast", "cardiff", "reading",
    "paris", "lyon", "toulouse", "marseille", "bordeaux", "lille", "nantes",
    "madrid", "barcelona", "valencia", "seville", "malaga", "bilbao",
    "lisbon", "porto", "milan", "rome", "turin", "bologna", "florence",
    "naples", "athens", "thessaloniki", "bucharest", "cluj", "timisoara",
    "sofia", "tallinn", "riga", "vilnius", "reykjavik",
)

# Gate order and the gates whose UNKNOWN counts in the roll-up.
GATE_ORDER = ("language", "experience", "sponsorship", "seniority", "pure_technical", "closed",
              "geography", "recency")
GATES_THAT_CAN_BE_UNKNOWN = ("language", "experience", "sponsorship", "seniority",
                             "pure_technical", "closed")
MAX_AGE_DAYS = 45
SNIPPET_CAVEAT = "the only text available is a truncated card snippet"
CUT_BODY_CAVEAT = "the fetched body was cut off at its length limit before the posting ended"

# ---- two-axis score --------------------------------------------------------------------------
# Weights of the two-axis score.
AXIS_WEIGHTS = {
    "domain": 30, "enabler": 20, "overlap": 35, "core_tech_penalty": -60,
    "description_bonus_cap": 25, "description_domain": 8, "description_enabler": 5,
    "hidden_hybrid_bonus": 15, "strong_hybrid_bonus": 40, "medium_hybrid_bonus": 20,
    "body_only_domain_scale": 70, "core_tech_exempt_min_body_domains": 2,
}
STRONG_ENABLERS = ("ai", "automation")
TITLE_WEIGHT, BODY_CAP = 10, 20

# ---- role signature --------------------------------------------------------------------------
# Grade words, joining words and abbreviations of a title.
GRADE_WORDS = (
    "senior", "sr", "snr", "junior", "jr", "jnr", "mid", "medior", "middle", "principal",
    "staff", "lead", "leader", "head", "chief", "associate", "advanced", "entry", "graduate",
    "intern", "trainee", "level", "i", "ii", "iii", "iv",
)
TITLE_STOPWORDS = ("of", "and", "or", "the", "for", "with", "a", "an", "in", "to", "at", "on")
TITLE_ABBREVIATIONS = (
    ("artificial intelligence", "ai"),
    ("machine learning", "ml"),
    ("business intelligence", "bi"),
    ("continuous improvement", "ci"),
    ("business process management", "bpm"),
    ("robotic process automation", "rpa"),
    ("supply chain management", "scm"),
)
TITLE_REF = r"^[a-z]{0,3}\d{3,}$"
SIMILARITY_PERCENT = 80

# ---- company names ---------------------------------------------------------------------------
# Noise in company names, removed in this order, and anglicised letters.
COMPANY_NOISE = (
    r"\ba/s\b", r"\baps\b", r"\bi/s\b", r"\bp/s\b", r"\bk/s\b", r"\bivs\b", r"\bamba\b",
    r"\ba\.m\.b\.a\.\b", r"\(vg\)", r"\(.*?\)", r"\bdanmark\b", r"\bdenmark\b",
    r"\bscandinavia\b", r"\bnordic\b", r"\bgroup\b", r"\bholding\b", r",\s*.*$",
)
ANGLICISED = (("ø", "o"), ("æ", "ae"), ("å", "aa"), ("ö", "o"), ("ä", "ae"), ("ü", "u"))
COMPANY_MIN_SCORE = 30

# ---- overall score ---------------------------------------------------------------------------
# Dimension weights, bands and final-gate thresholds.
OVERALL_WEIGHTS = {"technical": 0.30, "experience": 0.25, "behavioral": 0.15, "career": 0.30}
OVERALL_BANDS = ((75, "Strong Fit"), (60, "Good Fit"), (45, "Moderate Fit"), (30, "Weak Fit"))
LOWEST_BAND = "Poor Fit"
STRONG_SCORE, MIN_SCORE, DRAFT_CAP, ALERT_EXPIRY_DAYS = 75, 60, 5, 30
GATE_VALUES = ("PASS", "FLAG", "FAIL")

# ---- rule-based scores -----------------------------------------------------------------------
# Keyword lists of the rule-based scores.
STRONG_SKILLS = (
    "python", "pandas", "keras", "sql", "data science", "machine learning", "generative ai",
    "llm", "fine-tuning", "data analytics", "power bi", "dax", "process automation",
    "power automate", "selenium", "azure ml studio", "azure document intelligence", "vba",
    "power query",
)
MODERATE_SKILLS = (
    "ai product management", "mlops", "power apps", "supply chain analytics",
    "procurement analytics", "operations analytics", "business intelligence",
    "financial modeling", "automation",
)
REQUIRED_CLAUSE = r"(?:required|must have|essential|mandatory)[^\n.]*?[\n.]"
EXPERIENCE_RULES = (
    (r"\b0-2 years?\b", 100),
    (r"\b(graduate|junior|early[- ]career|entry level)\b", 100),
    (r"\b2-4 years?\b", 85),
    (r"\b4-6 years?\b", 55),
    (r"\b6\+ years?\b", 25),
    (r"\b(senior|staff|principal|head of)\b", 25),
    (r"\b(internship|student|working[- ]student)\b", 30),
    (r"\bformal people management\b", 30),
    (r"\bline management\b", 30),
)
BEHAVIORAL_POSITIVE = (
    "cross-functional", "high autonomy", "measurable business impact", "product shipping",
    "end-to-end", "ownership", "stakeholder management", "collaboration", "innovation",
    "problem solving", "decision making", "agile", "continuous improvement", "transformation",
)
BEHAVIORAL_NEGATIVE = (
    "maintenance", "keep the lights on", "rigid", "low autonomy", "isolated", "pure research",
    "no product exposure",
)
CAREER_TRACKS = {
    "T1": ("ai engineer", "ml engineer", "generative ai", "llm", "machine learning engineer",
           "ai specialist", "mlops", "ai", "ml", "generative", "neural", "deep learning"),
    "T2": ("data scientist", "data analyst", "bi developer", "bi analyst", "analytics engineer",
           "power bi", "business analyst", "data", "analytics", "bi", "business intelligence",
           "dashboard", "reporting"),
    "T3": ("ai product", "ai solutions", "ai strategy", "intelligent automation", "low-code ai",
           "automation engineer", "automation", "low-code"),
    "T4": ("supply chain", "operations analyst", "procurement", "demand planning", "logistics",
           "inventory", "operations"),
    "T5": ("performance manager", "performance analyst", "process manager",
           "process improvement", "business excellence", "digital transformation",
           "operational excellence", "performance", "process", "excellence", "transformation",
           "continuous improvement"),
}
CAREER_ADJACENT = ("software engineer", "devops", "data engineer", "backend", "frontend")
STRENGTH_KEYWORDS = ("python", "sql", "machine learning", "ai", "generative", "llm", "power bi",
                     "automation", "azure")

# ---- facts -----------------------------------------------------------------------------------
# Salary figures, in priority order, and ways to withhold one.
CURRENCY = r"(?:[€£$₣]|(?:EUR|GBP|USD|CHF|HUF|PLN|SEK|NOK|DKK|CZK|RON)\b)"
AMOUNT = (r"\d{1,3}(?:[ .,]\d{3})+(?:[.,]\d{1,2})?|\d{2,}(?:[.,]\d{1,2})?\s*[kK]?|"
          r"\d{1,3}\s*[kK]")
PERIOD = (r"(?:per\s+(?:year|annum|anno|month|hour|day|week)|p\.?a\.?\b|"
          r"/\s*(?:yr|year|month|mo|hour|hr|day)|annually|monthly|hourly|"
          r"yearly|a\s+year|a\s+month|an\s+hour)")
SALARY_STATED = (
    rf"{CURRENCY}\s*(?:{AMOUNT})\s*(?:-|–|—|to|up to)\s*{CURRENCY}?\s*(?:{AMOUNT})(?:\s*{PERIOD})?",
    rf"(?:{AMOUNT})\s*(?:-|–|—|to)\s*(?:{AMOUNT})\s*{CURRENCY}(?:\s*{PERIOD})?",
    rf"{CURRENCY}\s*(?:{AMOUNT})\s*{PERIOD}",
    rf"(?:{AMOUNT})\s*{CURRENCY}\s*{PERIOD}",
)
SALARY_WITHHELD = (
    r"salary\s+(?:is\s+)?(?:not\s+disclosed|undisclosed|confidential)",
    r"compensation\s+(?:is\s+)?(?:not\s+disclosed|undisclosed|confidential)",
    r"salary\s+(?:will\s+be\s+)?discussed\s+(?:during|at|in)",
    r"competitive\s+(?:salary|compensation|package|remuneration)",
    r"salary\s+(?:commensurate|depending|based)\s+(?:with|on)",
)

# Work-mode wording, in mode order, and the negators before it.
WORK_MODES = {
    "hybrid": (
        r"\bhybrid\s+(?:work|working|model|role|position|setup|arrangement)",
        r"\bhybrid\b(?!\s*(?:cloud|app|architecture))",
        r"\b\d\s*days?\s+(?:per|a)\s+week\s+(?:in|at)\s+the\s+office",
        r"\bpartially\s+remote",
    ),
    "remote": (
        r"\b(?:fully|100%|entirely|completely)\s*[- ]?\s*remote",
        r"\bremote[- ]first\b",
        r"\bwork\s+from\s+(?:home|anywhere)\b",
        r"\bremote\s+(?:work|working|position|role|job)\b",
        r"\bthis\s+is\s+a\s+remote\b",
        r"\(\s*remote\s*\)",
    ),
    "onsite": (
        r"\bon[- ]?site\b",
        r"\bin[- ]office\b",
        r"\bon\s+premises?\b",
        r"\boffice[- ]based\b",
        r"\bno\s+remote\s+work",
    ),
}
WORK_MODE_NEGATOR = r"\b(?:no|not|non|without|never|isn'?t|aren'?t|cannot|can'?t)\b"
WORK_MODE_NEGATOR_CHARS = 30

# Quota figures and error classes.
QUOTA_MARKERS = ("pre-consume quota failed", "insufficient", "quota", "预扣费额度", "额度不足",
                 "剩余额度")
QUOTA_HAVE = r"(?:user quota|用户剩余额度|剩余额度)\s*[:：]\s*[＄$]?\s*(-?[\d.]+)"
QUOTA_NEED = r"(?:need quota|需要预扣费额度|需要额度)\s*[:：]\s*[＄$]?\s*(-?[\d.]+)"
ERROR_CLASSES = (
    ("auth", ("auth", "authentication", "login failed", "sign in", "401", "credential")),
    ("permission", ("permission denied", "unauthorized", "forbidden")),
    ("quota", ("quota", "rate limit", "429")),
    ("credit", ("credit", "billing", "payment")),
    ("timeout", ("timeout", "timed out")),
    ("unknown", ("unclassified",)),
)

# ---- run log ---------------------------------------------------------------------------------
# Phases of a run, in order, with their weights in percent.
RUN_PHASES = (("0b", 4), ("1", 22), ("1b", 3), ("1c", 12), ("1b-final", 3), ("2", 38), ("2b", 2),
              ("3", 5), ("4", 6), ("5", 5))
RUN_COMPLETE_MESSAGE = "Pipeline complete."
RUN_STALL_SECONDS = 120

# ---- tracker ---------------------------------------------------------------------------------
# Columns of the tracker file.
TRACKER_COLUMNS = ("date", "company", "sector", "role", "role_type", "channel", "status",
                   "contact_person", "fit_rating", "notes", "cv_file", "cover_letter_file",
                   "source")

# ---- salary sheets ---------------------------------------------------------------------------
# Header words of salary sheets.
SHEET_COMPANY = ("firma", "company", "virksomhed", "employer", "arbejdsgiver")
SHEET_CITY = ("by", "city", "kommune", "location", "lokation", "sted")
SHEET_COUNT = ("antal", "count", "number", "n", "employees", "medarbejdere")
SHEET_INDEX = ("indeks", "index", "idx", "salary", "løn", "median", "average", "gennemsnit")
SHEET_COMPOUND = ("antal", "indeks", "løn", "gennemsnit", "medarbejdere")
SHEET_ID = ("id", "personnummer")

# ---- detail merge ----------------------------------------------------------------------------
# Body caps and the fields a fetched detail may carry.
DETAIL_CAP_HOST, DETAIL_CAP_OTHER = 20000, 6000
DETAIL_FIELDS = ("seniority", "employmentType", "jobFunction", "industries", "applyUrl")
DETAIL_MIN_CHARS = 400
