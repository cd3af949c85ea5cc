"""Default vocabulary: phrases, patterns, company lists and thresholds.

Everything here is data. Operators never read this module directly; they take a
``ScoringConfig`` (see ``rolesift.config.model``) whose defaults come from here, so
a deployment replaces any list from YAML without touching code.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Phrase lists that decide prefilter results.
# ---------------------------------------------------------------------------

SENIORITY_TITLES = [
    "intern", "internship", "entry level", "entry-level", "entry_level", "early career",
    "new grad", "new graduate", "new-grad", "graduate programme", "graduate program",
    "apprentice", "traineeship", "trainee", "junior", " jr ", " jr,", " jr.",
]

UNPAID_PHRASES = ["commission only", "no base salary", "unpaid", "equity only", "equity-only"]

LEADERSHIP_EXCEPTIONS = [
    "director of engineering", "vp of engineering", "vp engineering", "vp, engineering",
    "head of engineering", "engineering director", "chief engineer", "chief technology",
    "vp of technology", "vp technology", "vp, technology", "head of technology",
    "director of technology", "technology director", "design director", "director of design",
    "vp of design", "head of design", "chief design", "chief product", "vp of product",
    "vp product", "vp, product", "head of product", "director of product", "product director",
    "group product manager", "chief operating", "vp of operations", "vp operations",
    "vp, operations", "head of operations", "director of operations", "operations director",
    "chief of staff", "chief strategy", "vp of strategy", "head of strategy",
    "strategic advisor", "operating partner", "executive advisor", "vp analyst", "vp, analyst",
    "principal analyst", "chief data", "vp of platform", "vp platform", "vp, platform",
    "head of platform", "platform director", "director of platform", "vp of online services",
    "vp online services", "vp, online services", "head of online services",
    "director of online services", "vp of infrastructure", "vp infrastructure",
    "vp, infrastructure", "head of infrastructure", "director of infrastructure",
    "vp of game services", "vp game services", "vp, game services", "head of game services",
    "platform engineering director", "director of platform engineering",
    "head of platform engineering", "vp of platform engineering", "vp platform engineering",
    "vp, platform engineering", "online services director",
    "director of online services engineering", "head of online services engineering",
    "vp of live service", "vp live service", "vp, live service", "head of live service",
    "director of live service", "live service director", "executive producer", "showrunner",
    "general counsel",
]

LEADERSHIP_ACRONYMS = ["cto", "coo", "cpo"]

LEADERSHIP_PATTERNS = [
    r"\bhead\s+of\b", r"\bvp\b", r"\bvice\s+president\b", r"\bsvp\b",
    r"\bsenior\s+vice\s+president\b", r"\bevp\b", r"\bexecutive\s+vice\s+president\b",
    r"\bchief\s+\w", r"\bcto\b", r"\bcio\b", r"\bceo\b", r"\bdirector\b",
    r"\bsenior\s+director\b", r"\bsr\.?\s+director\b", r"\bexecutive\s+director\b",
    r"\bmanaging\s+director\b",
    r"\bassociate\s+director\b[^.]*?\b(?:architect|platform|strategy|technology|engineering)\b",
    r"\b(?:engineering|technology|platform|technical\s+program|program)\s+manager\b",
    r"\bprincipal\s+analyst\b", r"\bvp\s+analyst\b", r"\bsr\.?\s+director\s+analyst\b",
    r"\bsenior\s+director\s+analyst\b",
]

PRIORITY_TITLES = [
    "ads performance", "ad performance", "performance ads", "performance advertising",
    "performance marketing", "ads product", "user acquisition", "paid social", "paid media",
    "ads experience", "ads platform", "advertising experience", "advertising product",
]

DILUTING_PREFIXES = [
    "associate ", "asst. ", "asst ", "assistant ", "junior ", "jr ", "jr. ", "3d ", "2d ",
    "visual ", "graphic ", "interaction ", "ui ", "ui/ux ", "ux ", "ux/ui ", "motion ", "set ",
    "costume ", "sound ", "lighting ",
]

WARN_TEMP_CONTRACT = [
    "(temporary)", "(temp)", "(short term)", "(short-term)", "temporary)", "seasonal",
    "part-time", "part time", "staff augmentation", "temp-to-perm", "short-term assignment",
]
WARN_D2C_TITLE = [
    "d2c", " commerce", "payments", "payment", "e-commerce", "ecommerce", " ads", "advertising",
    "performance marketing", "growth marketing", "demand generation",
]
WARN_TPM = ["technical program manager", "tpm,"]
WARN_BELOW_VP = ["senior manager", "sr manager", "sr. manager", "manager,", "associate"]
WARN_CRUNCH = [
    "fast-paced", "move fast", "high-velocity", "ship fast", "bias for action",
    "bias to action", "hustle", "grind", "relentless", "wear many hats",
    "roll up your sleeves", "scrappy", "startup pace", "thrives under pressure",
    "deadline-driven", "aggressive timelines", "crunch", "always-on",
]
WARN_CULTURE = [
    "work hard, play hard", "we're a family", "like a family", "rockstar", "ninja", "10x",
    "eat sleep breathe", "whatever it takes", "not a 9-to-5", "not for the faint of heart",
    "no clock-watchers",
]
WARN_RTO = [
    "5 days in office", "five days in office", "in-office 5 days", "fully on-site",
    "fully onsite", "100% on-site", "100% in office", "no remote", "rto mandate", "5-day rto",
]
WARN_HANDS_ON = [
    "hands-on coder", "write production code", "individual contributor engineer",
    "ic engineer", "full-stack developer", "actively coding", "coding required",
    "pr reviews daily", "push code", "commit code", "ship code", "pair programming",
    "on-call rotation", "production on-call", "kubernetes hands-on", "deploy pipelines",
    "leetcode", "coding interview", "live coding", "take-home coding", "50% coding",
]

POSITIVE_SIGNALS = {
    "strategy": [
        "corporate strategy", "enterprise strategy", "strategic planning",
        "strategy & operations", "strategy and operations", "chief of staff", "vp analyst",
        "principal analyst", "industry analyst", "market intelligence",
        "competitive intelligence", "research director", "thought leadership", "advisory",
        "executive advisor", "strategic advisor", "business transformation",
        "operating model", "portfolio strategy", "growth strategy", "horizon planning",
        "tech strategy", "technology strategy", "product strategy", "go-to-market strategy",
        "platform strategy", "capability roadmap",
    ],
    "architecture": [
        "technology program management", "tpm", "enterprise program", "program director",
        "head of programs", "enterprise architecture", "enterprise architect",
        "solutions architecture", "technology architecture", "chief architect",
        "reference architecture", "domain architecture", "capability model",
        "target state architecture", "technology steering", "architecture review board",
        "arb", "technology governance", "it governance", "platform strategy",
        "technology roadmap", "program management office", "pmo",
    ],
    "ma_pmi": [
        "m&a integration", "post-merger integration", "post-acquisition integration", "pmi",
        "integration management office", "imo lead", "carve-out", "divestiture",
        "day 1 readiness", "synergy capture", "integration playbook", "deal integration",
        "transaction advisory", "corporate development", "inorganic growth",
        "technology due diligence", "tech dd", "acquisition integration",
    ],
    "senior_titles": [
        "vice president", "vp", "svp", "senior vice president", "evp",
        "executive vice president", "head of", "director", "senior director", "principal",
        "distinguished", "fellow", "practice lead", "managing director", "general manager",
    ],
    "gaming": [
        "for the players", "games industry", "game development", "game developer",
        "game studio", "game studios", "games studio", "live service", "live services",
        "live ops", "live operations", "player experience", "players and creators",
        "creators and players", "creator economy", "creator platform", "developer community",
        "game community", "gaming platform", "game platform", "game engine", "unreal engine",
        "unity engine", "game services", "game production", "multiplayer", "matchmaking",
        "mmo", "f2p", "free-to-play", "battle pass", "battle royale", "esports",
        "competitive gaming", "game design", "gameplay", "narrative",
        "intellectual property", "franchise", "studio", "avatars", "virtual world",
        "virtual worlds", "metaverse", "experiences on", "our platform reaches",
        "monthly active users",
    ],
    "immersive": [
        "immersive", "experiential", "location-based entertainment", "lbe", "escape room",
        "themed entertainment", "installation", "exhibit", "interactive experience",
        "virtual reality", "augmented reality", "extended reality", "projection mapping",
        "dark ride", "attraction", "guest experience", "visitor experience",
    ],
    "tcg_boardgame": [
        "trading card game", "tcg", "ccg", "collectible card", "deckbuilding", "board game",
        "tabletop", "strategy game", "magic the gathering", "pokemon", "yu-gi-oh", "mtg",
    ],
    "music": [
        "music", "musician", "artist", "daw", "audio", "sound design", "live events",
        "concerts", "ticketing", "streaming audio", "instrument", "producer", "songwriter",
        "label", "recording",
    ],
    "mission": [
        "mission-driven", "making lives better", "helping people", "social impact",
        "community impact", "serve our users", "user well-being", "for the players",
        "accessibility", "underrepresented", "mental health", "suicide prevention",
        "crisis support", "nonprofit", "501(c)(3)", "social good",
    ],
    "interim": [
        "interim", "fractional", "fractional cto", "fractional cio", "contract",
        "contractor", "contract-to-hire", "1099", "w2 contract", "consultant",
        "consulting engagement", "sow", "statement of work", "project-based", "fixed-term",
        "ftc", "temp-to-perm", "short-term assignment", "engagement", "advisor",
        "advisory role", "board advisor", "6-month contract", "12-month contract",
        "day rate", "hourly rate",
    ],
    "lgbtq": [
        "gender identity", "sexual orientation", "lgbtq+", "lgbtqia+", "transgender",
        "non-binary", "pride erg", "out@", "spectrum erg", "domestic partner benefits",
        "transgender-inclusive healthcare", "gender-affirming care",
        "family-forming benefits", "fertility benefits", "adoption assistance",
        "surrogacy benefits", "equal parental leave", "gender-neutral parental leave",
        "pronouns", "human rights campaign", "equality 100", "best place to work for lgbtq",
    ],
    "family_friendly": [
        "flexible schedule", "flexible hours", "family-friendly", "parental leave",
        "paid parental leave", "caregiver leave", "backup childcare", "work-life balance",
        "4-day work week", "summer hours", "no weekend work",
    ],
    "nj_office": [
        "jersey city", "hoboken", "mountain lakes", "parsippany", "newark", "morristown",
        "short hills",
    ],
    "multiplayer_live_service": [
        "multiplayer infrastructure", "multiplayer backend", "live service", "live ops",
        "live operations", "online services", "online services platform", "matchmaking",
        "concurrent players", "game services", "platform engineering", "merchant of record",
        "subscription platform", "post-merger integration", "shared services",
    ],
}
# Title words too weak to cancel the below-VP warning.
WEAK_SENIOR_TITLES = ["principal", "director"]

INDUSTRY_SCORES = {
    "gaming_publisher_platform": 10, "digital_tcg_ccg": 10, "immersive_lbe": 9,
    "gaming_b2b_infrastructure": 9, "music_tech": 8, "gaming_accessibility_nonprofit": 8,
    "streaming_media": 7, "analyst_firm": 7, "gaming_vc_pe_operating": 7,
    "sports_betting_tech": 6, "science_education_nonprofit": 6, "hospitality_tech": 5,
    "defense_simulation": 4, "general_enterprise_tech": 3, "adtech_martech": 2,
    "crypto_web3": 1,
}

INDUSTRY_KEYWORDS = {
    "gaming_publisher_platform": [
        "game studio", "video game", "mobile game", "gaming platform", "console game",
        "esports", "live service game", "free-to-play", "battle pass",
    ],
    "digital_tcg_ccg": [
        "trading card game", "tcg", "ccg", "collectible card", "deckbuilding",
    ],
    "immersive_lbe": [
        "immersive entertainment", "location-based entertainment", "lbe",
        "themed entertainment", "escape room", "experiential venue", "dark ride",
        "attraction operator",
    ],
    "gaming_b2b_infrastructure": [
        "game backend", "gaming infrastructure", "gaming sdk", "game platform services",
        "matchmaking service", "game server",
    ],
    "music_tech": [
        "music technology", "music platform", "audio technology", "music streaming",
        "live events platform", "ticketing platform",
    ],
    "sports_betting_tech": [
        "sports betting", "sportsbook", "igaming", "online gambling", "wagering",
        "fantasy sports", "daily fantasy",
    ],
    "streaming_media": [
        "streaming media", "sports media", "broadcast", "media company", "digital media",
        "content platform",
    ],
    "analyst_firm": [
        "research firm", "analyst firm", "market research", "industry analyst",
        "advisory firm",
    ],
    "gaming_accessibility_nonprofit": [
        "gaming nonprofit", "games for health", "digital therapeutics",
        "game-based learning", "games and mental health",
    ],
    "hospitality_tech": [
        "hospitality technology", "restaurant technology", "restaurant platform",
        "hotel technology", "foodservice technology",
    ],
    "science_education_nonprofit": [
        "science museum", "natural history", "education nonprofit", "cultural institution",
    ],
    "crypto_web3": ["web3", "blockchain", "cryptocurrency", "defi", "nft", "crypto"],
}

PIVOT_INDUSTRIES = [
    "immersive_lbe", "digital_tcg_ccg", "music_tech", "gaming_accessibility_nonprofit",
]

# Order of the groups is the order of precedence.
LOCATION_PATTERNS = {
    "heavy_office": [
        r"\bin[- ]office (5|five) days\b", r"\bfully on-?site\b",
        r"\b100% (on-?site|in office)\b", r"\bno remote\b", r"\bRTO mandate\b",
    ],
    "out_of_area": [
        r"\bon[- ]site.*(Seattle|Redmond|Bellevue|San Francisco|SF|Bay Area|Los Angeles|LA"
        r"|Austin|Boston|Cupertino|Mountain View)\b",
        r"\b(Seattle|Redmond|San Francisco|Los Angeles|Austin|Boston|Cupertino).*"
        r"\b(in[- ]office|on[- ]site|5 days)\b",
        r"\brelocation (required|assistance|package)\b", r"\bwillingness? to relocate\b",
        r"\bmust relocate\b",
        r"\bon[- ]site in (Seattle|Redmond|Cupertino|Mountain View|Austin|San Francisco"
        r"|Los Angeles)\b",
    ],
    "nj_office": [
        r"\b(Jersey City|Hoboken|Hoboken NJ|Newark NJ|Parsippany|Morristown|Mountain Lakes"
        r"|Short Hills)\b",
    ],
    "nyc_metro": [
        r"\bhybrid\b.*\b(NYC|New York|Manhattan)\b", r"\b(NYC|New York)\b.*\bhybrid\b",
        r"\b[23]\s*days?\s*(in\s*office|in-office|onsite|on-site)\b", r"\bNew York,? NY\b",
        r"\bNYC[ -]based\b", r"\b(Tribeca|Midtown|SoHo|Flatiron|Hudson Yards|Brooklyn)\b",
        r"\b(Jersey City|Hoboken|Mountain Lakes|Morristown|Parsippany)\b",
    ],
    "remote_us": [
        r"\b(fully|100%|completely)?\s*remote\b", r"\bwork from anywhere\b",
        r"\bremote-first\b", r"\bremote[ -]friendly\b", r"\bdistributed team\b",
        r"\bUS remote\b", r"\bremote \(US\)\b", r"\banywhere in the (US|United States)\b",
    ],
}
RELOCATION_PATTERNS = [
    r"\brelocation (required|assistance|package)\b", r"\bwillingness? to relocate\b",
    r"\bmust relocate\b",
]
TRAVEL_PATTERN = r"travel\s*(up to|:)?\s*(\d{2,3})\s*%"

# Score thresholds, best tier first.
TIERS = {"T1": 78, "T2": 65, "T3": 50, "watchlist": 35}

# ---------------------------------------------------------------------------
# Weighted generation.
# ---------------------------------------------------------------------------

CATEGORY_WEIGHTS = {
    "role_fit": 0.22, "industry_alignment": 0.18, "compensation": 0.14, "geographic": 0.14,
    "passion_identity": 0.06, "work_life_quality": 0.12, "company_health": 0.04,
    "career_trajectory": 0.04, "cultural_alignment": 0.06, "engagement_type": 0.0,
}
LOCATION_SCORES = {
    "international": 2, "remote_us": 10, "nj_office": 9, "nyc_heavy": 6, "nyc_hybrid_3d": 8,
    "ambiguous": 4,
}
D2C_PAYMENTS = [
    "d2c", "direct-to-consumer", "payments", "checkout", "e-commerce", "digital commerce",
    "conversion rate",
]
BENEFIT_TERMS = [
    "healthcare", "dental", "vision", "401k", "401(k)", "pto", "paid time off", "equity",
    "bonus",
]
EQUITY_STEPS = [
    (["rsu", "rsus", "restricted stock"], 1.0),
    (["series d", "series e", "series f"], 0.8),
    (["series b", "series c"], 0.5),
    (["series a", "seed"], 0.3),
]
GAMING_ADJACENT = [
    "gaming_publisher_platform", "gaming_b2b_infrastructure", "digital_tcg_ccg",
    "immersive_lbe", "gaming_accessibility_nonprofit", "gaming_vc_pe_operating",
]
STRATEGY_PASSION_EXTRA = ["music_tech", "streaming_media", "sports_betting_tech"]
ACCESSIBLE_GAMING = [
    "accessible gaming", "ablegamers", "take this", "games for change", "suicide prevention",
]
IC_PRINCIPAL = [
    "principal engineer", "principal scientist", "principal developer",
    "principal designer", "principal researcher", "principal data", "principal ml",
    "principal swe", "principal sde",
]
# Level of a title, first hit wins.
LEADERSHIP_LEVELS = [
    (["chief", "c-suite", "evp", "executive vice president", "group svp"], 10.0),
    (["svp", "senior vice president", "vice president", "vp ", " vp", "head of",
      "general manager"], 9.0),
    (["senior director", "principal", "managing director", "practice lead",
      "distinguished"], 7.0),
    (["director"], 6.0),
    (["senior manager", "lead ", " lead", "manager"], 4.0),
    (["senior"], 3.0),
]
ON_CALL = ["on-call", "24/7", "24x7"]
# Company-health adjustments, all that hit are added.
HEALTH_STEPS = [
    (["nasdaq", "nyse", "publicly traded", "public company"], 1.0),
    (["profitable", "profitability", "cash flow positive"], 1.0),
    (["series d", "series e", "series f", "growth stage", "late stage"], 2.0),
    (["series b", "series c"], 1.0),
    (["restructuring", "reorg", "cost cutting", "workforce reduction", "layoff"], -2.0),
    (["pre-revenue", "pre-product", "pre-launch"], -1.0),
]
REPORTS_TO_C = [
    "reports to ceo", "reports to cto", "reports to coo", "reports to cpo",
    "reports to ciso", "reports to president", "directly to the ceo", "dotted line to ceo",
]
REPORTS_TO_DIRECTOR = [
    "reports to a director", "reports to the director", "reports to director",
]
SCOPE_WIDE = [
    "global", "enterprise-wide", "company-wide", "cross-functional", "all business units",
]
SCOPE_NARROW = ["regional", "single market", "one country"]
BRAND_COMPANIES = [
    "riot games", "roblox", "epic games", "netflix", "disney", "nbcuniversal",
    "warner bros discovery", "sony interactive entertainment", "microsoft", "gartner",
    "forrester", "draftkings", "fanduel", "betmgm",
]
CULTURE_ROLLBACK = [
    "politically neutral", "we don't do dei", "merit-based only", "end dei", "no pronouns",
]
ENGAGEMENT_STEPS = [
    (["interim", "fixed-term", "ftc", "short-term assignment", "6-month", "12-month",
      "day rate"], 10.0),
    (["fractional", "part-time retainer", "advisory role", "board advisor"], 9.0),
    (["advisory", "board seat"], 7.0),
    (["3-month", "2-month", "short contract"], 5.0),
    (["unpaid", "equity only", "commission only"], 0.0),
]
SALARY_FLOOR = 175_000
COMPENSATION = {
    "neutral": 5.0, "low": 175_000, "mid_lower": 175_000, "mid_upper": 200_000,
    "high_max": 260_000, "overpay_max": 340_000,
}
INTERNATIONAL_TITLES = [
    "uae", "dubai", "abu dhabi", "middle east", "saudi arabia", "ksa", " apac", " emea",
    " latam", "singapore", "tokyo", "japan", "australia", "sydney", "germany", "berlin",
    "amsterdam", "paris", " uk,", " london,",
]
US_LOCATION_TERMS = [
    "united states", "usa", ", ca", ", ny", ", wa", ", tx", ", ma", ", il", ", ga", "remote",
]
ASSOCIATE_PASSTHROUGH = [
    "associate vice president", "associate vp", "associate partner",
    "associate general counsel", "associate principal",
]
ASSOCIATE_CRAFT = [
    "3d", "2d", "visual", "graphic", "interaction", "ui", "ux", "motion", "set", "costume",
    "sound", "lighting", "creative", "art", "experience", "product design", "brand",
    "marketing", "events", "social", "content",
]

# Modifier deltas; names are the labels reported for a posting.
MODIFIER_DELTAS = {
    "company_tier_s": 10, "company_tier_1": 6, "company_tier_2": 3, "immersive_themed": 8,
    "tcg_ccg": 8, "ma_gaming_media": 6, "vp_analyst": 5, "remote_vp_gaming": 5,
    "nj_office_bonus": 3, "mental_health_accessibility": 4, "hrc_trans_inclusive": 3,
    "multiplayer_live_service": 6, "interim_advisor_fit": 6, "below_vp_title": -10,
    "d2c_in_title": -12, "temp_contract_title": -10, "d2c_heavy": -8, "coding_heavy": -10,
    "crunch_culture": -8, "high_travel": -5, "rto_mandate": -8,
}
MOD_IMMERSIVE_INDUSTRIES = ["immersive_lbe"]
MOD_IMMERSIVE = [
    "escape room", "immersive", "themed entertainment", "lbe", "location-based entertainment",
]
MOD_TCG = ["trading card game", "tcg", "ccg", "collectible card", "deckbuilding"]
MOD_MA_INDUSTRIES = [
    "gaming_publisher_platform", "digital_tcg_ccg", "immersive_lbe", "music_tech",
    "streaming_media", "gaming_b2b_infrastructure",
]
MOD_VP_ANALYST = ["vp analyst", "principal analyst", "vp, analyst"]
MOD_REMOTE_VP_INDUSTRIES = [
    "gaming_publisher_platform", "gaming_b2b_infrastructure", "digital_tcg_ccg",
]
MOD_EXEC_WORDS = ["vp", "vice president", "head of", "chief", "director"]
MOD_MISSION = [
    "mental health", "accessibility", "accessible gaming", "crisis support",
    "suicide prevention", "disability",
]
MOD_LIVE_INDUSTRIES = [
    "gaming_publisher_platform", "gaming_b2b_infrastructure", "digital_tcg_ccg",
    "immersive_lbe", "streaming_media",
]
MOD_ENGAGEMENT_MARKERS = [
    "interim", "fractional", "advisor", "advisory", "operating partner",
    "executive in residence", "eir",
]
MOD_SCOPE_MARKERS = [
    "cto", "chief technology", "chief product", "chief operating", "technology", "platform",
    "strategy", "product", "transformation", "engineering", "operations",
]
MOD_INCLUSIVE_HEALTH = [
    "transgender-inclusive healthcare", "gender-affirming care", "trans-inclusive",
    "gender affirming",
]
MOD_EXEC_TITLES = [
    "director", "vp ", " vp", "vp,", "vice president", "svp", "evp", "chief", "head of",
    "general manager", "managing director", "fellow", "cto", "cfo", "ceo", "coo", "cmo",
    "cpo", "cro", "chro", "cio", "ciso",
]
MOD_BELOW_VP = [
    "senior manager", "sr. manager", "sr manager", " manager", "coordinator", "specialist",
    " lead", "lead ", " associate", "associate ",
]
MOD_BELOW_VP_STARTS = ["manager,", "manager ", "associate ", "associate,"]
MOD_D2C_TITLE = [
    "d2c", " commerce", "payments", "payment", "e-commerce", "ecommerce", " ads",
    "advertising", "performance marketing", "growth marketing",
]
MOD_TEMP_TITLE = [
    "(temporary)", " temporary", "temporary)", "(contract)", "(contractor)", "temp-",
    " temp ", "short-term", "short term", "(short term)", "seasonal", "part-time",
    "part time",
]
MOD_TEMP_EXEMPT = ["interim", "fractional", "advisor", "consultant"]

# ---------------------------------------------------------------------------
# Engagement labels, in order of priority.
# ---------------------------------------------------------------------------

ENGAGEMENT_RULES = {
    "interim_fractional": [
        "interim cto", "interim cio", "interim cpo", "interim coo", "interim chief",
        "interim vp", "interim head of", "fractional cto", "fractional cio",
        "fractional cpo", "fractional coo", "fractional cfo", "fractional cmo",
        "fractional chief", "fractional vp", "fractional head of", "fractional executive",
        "interim leadership", "fractional leadership",
    ],
    "advisor": [
        "advisor", "advisory role", "advisory board", "operating partner",
        "executive advisor", "strategic advisor", "board advisor", "technical advisor",
        "executive in residence", " eir ", "(eir)",
    ],
    "contract": [
        "(contract)", "(contractor)", "contract-to-hire", "contract to hire", " 1099 ",
        " 1099,", "(1099)", "w2 contract", "w-2 contract", "day rate", "hourly rate",
        "(temporary)", " temporary ", "temp-to-perm", "temp to perm",
        "short-term assignment", "short term assignment", "(short term)", "(short-term)",
        "project-based", "project based", "fixed-term", "fixed term contract", " ftc,",
        "6-month contract", "12-month contract", "statement of work", " sow ", "(sow)",
        "consulting engagement",
    ],
}
ENGAGEMENT_LABELS = {
    "fulltime": "Full-time", "interim_fractional": "Interim / Fractional",
    "advisor": "Advisor", "contract": "Contract", "unclear": "Unclear",
}

# Quality-of-life weights and thresholds.
QOL_WEIGHTS = {
    "work_mode_remote": 25, "work_mode_hybrid": 15, "salary_listed": 20,
    "salary_above_floor": 15, "posted_recent": 10, "equity_keywords": 10,
    "benefits_keywords": 10, "flexibility_keywords": 10,
}
QOL_SALARY_FLOOR = 180_000
QOL_RECENT_DAYS = 14

# ---------------------------------------------------------------------------
# Own defaults: lists the engine expects but for which no values are prescribed.
# ---------------------------------------------------------------------------

QOL_EQUITY = ["rsu", "equity", "stock options"]
QOL_BENEFITS = ["parental leave", "401k", "health insurance", "dental"]
QOL_FLEXIBILITY = ["flexible hours", "flexible schedule", "4-day work week", "work from anywhere"]

# Individual-contributor titles outside the target function. The list is a rule
# (craft x role) plus a few whole phrases; a deployment passes its own list.
FUNCTION_CRAFTS = [
    "software", "machine learning", "ml", "data", "platform", "security", "firmware",
    "site reliability", "devops", "backend", "frontend", "full-stack", "mobile", "ios",
    "android", "qa", "test", "cloud", "infrastructure", "ai", "gameplay", "graphics",
    "rendering", "tools", "audio", "network", "application", "research", "quality",
    "automation", "hardware", "systems", "web", "it", "analytics", "senior", "staff",
    "principal", "lead", "embedded",
]
FUNCTION_ROLES = [
    "engineer", "programmer", "developer", "scientist", "analyst", "designer", "tester",
    "administrator",
]
FUNCTION_PHRASES = [
    "applied scientist", "copywriter", "technical writer", "talent acquisition",
    "people operations", "payments lead", "marketing manager", "community manager",
    "engineering manager", "data science", "public affairs", "3d artist", "concept artist",
    "sales representative", "account executive", "technical program manager",
    "supply chain manager", "policy manager", "training specialist",
]

TAXONOMY_INDUSTRIES = {
    "gaming": {"keywords": ["live service", "matchmaking", "esports", "video game"],
               "companies": ["riot games", "roblox"]},
    "tabletop": {"keywords": ["trading card game", "board game"], "companies": []},
    "fintech": {"keywords": ["payments", "fintech", "banking platform"],
                "companies": ["stripe", "plaid"]},
    "enterprise": {"keywords": ["m&a integration", "enterprise software", "corporate strategy"],
                   "companies": ["oracle", "sap"]},
    "startup": {"keywords": ["series b", "seed", "equity only"], "companies": []},
}
TAXONOMY_ROLE_TYPES = {
    "executive": {"title_keywords": ["vp", "chief", "head of", "cto"],
                  "title_excludes": ["associate"], "description_keywords": ["reports to ceo"]},
    "engineering": {"title_keywords": ["engineer", "developer"],
                    "title_excludes": ["engineering manager", "head of"],
                    "description_keywords": ["pair programming"]},
    "product": {"title_keywords": ["product"], "title_excludes": ["ads"],
                "description_keywords": ["product strategy"]},
    "data": {"title_keywords": ["data ", "analyst", "machine learning"], "title_excludes": [],
             "description_keywords": []},
    "operations": {"title_keywords": ["operations", "program manager"], "title_excludes": [],
                   "description_keywords": ["operating model"]},
}
TAXONOMY_GROUPS = {
    "games_first": ["riot games", "roblox", "epic games"],
    "media": ["netflix", "disney", "spotify"],
}

# Companies known by name (key -> industry bucket); larger lists come as a table.
COMPANY_INDUSTRIES = {
    "riot games": "gaming_publisher_platform", "roblox": "gaming_publisher_platform",
    "epic games": "gaming_publisher_platform", "unity": "gaming_b2b_infrastructure",
    "wizards of the coast": "digital_tcg_ccg", "meow wolf": "immersive_lbe",
    "spotify": "music_tech", "netflix": "streaming_media", "gartner": "analyst_firm",
    "draftkings": "sports_betting_tech", "resy": "hospitality_tech",
}
EQUALITY_COMPANIES = ["riot games", "spotify", "netflix", "microsoft", "apple"]
CRUNCH_COMPANIES = ["rockstar games", "naughty dog", "bungie", "riot games"]
CRUNCH_REDUCED_COMPANIES = ["riot games"]
