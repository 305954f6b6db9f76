"""Fixed values of the labelling rules, kept together as plain text.

Patterns use the ECMAScript reading of ``\\b`` and ``\\s`` (see ``patterns``).
"""

# --- fixed values: stop words of the repeated-word test ---------------------------------
REPEAT_STOP_WORDS = (
    "the a an and or but if then is are was were be been being to of in on for with from by "
    "at as it this that these those i you he she we they my your his her our their me us them "
    "do does did have has had will would can could should not no so than also"
).split()

# --- fixed values: Unicode block of each script and the language it stands for -----------
SCRIPT_BLOCKS = [
    ("pan", "\u0A00-\u0A7F"), ("hin", "\u0900-\u097F"), ("arb", "\u0600-\u06FF"),
    ("heb", "\u0590-\u05FF"), ("ben", "\u0980-\u09FF"), ("guj", "\u0A80-\u0AFF"),
    ("tam", "\u0B80-\u0BFF"), ("tel", "\u0C00-\u0C7F"), ("kan", "\u0C80-\u0CFF"),
    ("mal", "\u0D00-\u0D7F"), ("tha", "\u0E00-\u0E7F"), ("lao", "\u0E80-\u0EFF"),
    ("bod", "\u0F00-\u0FFF"), ("mya", "\u1000-\u109F"), ("kat", "\u10A0-\u10FF"),
    ("hye", "\u0530-\u058F"), ("ell", "\u0370-\u03FF"), ("rus", "\u0400-\u04FF"),
]
LATIN_LANGUAGES = ["eng", "spa", "fra", "deu", "ind", "vie"]

# --- fixed values: relevance -------------------------------------------------------------
OFF_TOPIC = [
    "my passport backup", "passport holder", "passport wallet", "passport cover",
    "passport compartment", "bike & brew passport", "passport to worlds", "passport to world",
    "honda passport", "passport trailsport", "passport trail sport", "passport suv",
    "passport model", "passport vehicle", "freefire passport", "free fire passport",
    "passport game", "coffee passport", "food passport", "beer passport", "brewery passport",
    "summer passport", "passport challenge",
]
ON_TOPIC = [
    r"\bpassport\s+(application|applications)\b",
    r"\bpassport\s+(apply|applying|applied)\b",
    r"\bapply\s+for\s+(a\s+)?passport\b",
    r"\bnew\s+passport\b",
    r"\bpassport\s+(renewal|renew|renewing|renewed)\b",
    r"\brenew\s+(my|your|a)\s+passport\b",
    r"\bpassport\s+(reissue|re-issue)\b",
    r"\bre-?issue\s+(my|your|a)\s+passport\b",
    r"\bexpired\s+passport\b",
    r"\bpassport\s+appointment\b",
    r"\bpassport\s+office\b",
    r"\bpassport\s+seva\b",
    r"\bpassport\s+service\b",
    r"\bpassport\s+(verification|police verification)\b",
    r"\bpassport\s+(documents?|requirements?|eligibility)\b",
    r"\bpassport\s+(number|validity|biometric|photo)\b",
    r"\bpassport\s+(issue|issues|problem|problems)\b",
    r"\bpassport\s+(rejected|rejection|approved|approval)\b",
    r"\bpassport\s+(and|or|with)\s+(visa|travel|immigration|border|airport)\b",
    r"\b(visa|travel|immigration|border|airport)\s+(and|with|using)\s+(my\s+)?passport\b",
    r"\b(chinese|indian|british|american|us|uk|canadian|australian|portuguese|french|german)\s+passport\b",
    r"\bpassport\s+(name|names|holder|holders)\b",
    r"\bmy\s+passport\b",
    r"\bpassport\s+was\b",
    r"\bpassport\s+has\b",
    r"\bpassport\s+is\b",
]
TOPIC_WORD = "passport"
RELATED_TERMS = ["visa", "immigration", "travel document", "travel documents"]

# --- fixed values: category rules, first group with a match wins -------------------------
CATEGORY_RULES = {
    "Appointments": [
        r"\bpassport appointment\b", r"\bappointment slot\b", r"\bpassport slot\b",
        r"\bpassport.*appointment\b", r"\bappointment.*passport\b",
        r"\breschedul.*appointment\b",
    ],
    "Renewal": [
        r"\bpassport renewal\b", r"\bpassport renewals\b", r"\brenew passport\b",
        r"\brenewing passport\b", r"\bpassport reissue\b", r"\bpassport re-issue\b",
        r"\breissue passport\b", r"\bre-issue passport\b", r"\bexpired passport\b",
        r"\bpassport expired\b",
    ],
    "Tatkal": [
        r"\btatkal passport\b", r"\btatkal\b", r"\burgent passport\b",
        r"\bexpedited passport\b",
    ],
    "Scams/Fraud": [
        r"\bpassport scam\b", r"\bpassport fraud\b", r"\bpassport scammer\b",
        r"\bfake passport agent\b", r"\bfake passport website\b", r"\bfake passport site\b",
        r"\bfake agent\b", r"\bpassport phishing\b", r"\bfraudulent passport\b",
    ],
    "Visa": [
        r"\bvisa approved\b", r"\bvisa approval\b", r"\bvisa application\b",
        r"\bvisa requirement\b", r"\bvisa requirements\b", r"\bvisa[- ]free\b",
        r"\bvisa.*passport\b", r"\bpassport.*visa\b", r"\bpassport index\b",
        r"\bpassport ranking\b", r"\bpassport.*doors\b",
    ],
    "Application": [
        r"\bpassport application\b", r"\bpassport apply\b", r"\bapply for.*passport\b",
        r"\bhow to apply.*passport\b", r"\bnew passport\b", r"\bpassport documents?\b",
        r"\bpassport eligibility\b", r"\bpassport requirements?\b", r"\bpassport photo\b",
        r"\bpassport size photo\b", r"\bpassport-size photo\b",
        "पासपोर्ट फोटो", "पासपोर्ट साइज फोटो", "पासपोर्ट के लिए फोटो",
        "পাসপোর্ট করার জন্য", "প্রয়োজনীয় কাগজপত্র", "పాస్‌పోర్ట్",
    ],
    "Travel Issues": [
        r"\bpassport.*airport\b", r"\bpassport.*border\b", r"\bpassport.*immigration\b",
        r"\bimmigration.*passport\b", r"\bborder.*passport\b", r"\bpassport.*denied\b",
        r"\bpassport.*stopped\b", r"\bstopped.*passport\b", r"\bpassport.*entry\b",
        r"\bentry.*passport\b",
    ],
    "Government Announcements": [
        r"\bgovernment.*passport\b", r"\bpassport.*government\b", r"\bministry.*passport\b",
        r"\bpassport.*ministry\b", r"\bofficial.*passport\b", r"\bpassport.*official\b",
        r"\bnew passport rule\b", r"\bpassport new rule\b", r"\bpassport policy\b",
        r"\bpassport rules\b", r"\btrump.*passport\b", r"\bpassport.*trump\b",
    ],
    "News": [
        r"\bpassport controversy\b", r"\bpassport scandal\b", r"\bpassport news\b",
        r"\bpassport report\b", r"\bpassport investigation\b", r"\bpassport announcement\b",
        r"\bpassport ban\b", r"\bpassport costs\b", r"\bpassport discovered\b",
        r"\bpassport history\b", r"\bfirst passport\b", r"\bpassport index\b",
        r"\bpassport ranking\b", r"\bpassport.*controversy\b", r"\bpassport.*investigation\b",
        r"\bpassport.*political\b", "สอบ.*th-ai passport", "th-ai passport.*สอบ",
        "พิรุธ", "ฮั้วประมูล",
    ],
    "Personal Experiences": [
        r"\bmy passport\b", r"\bi got my passport\b", r"\bi received my passport\b",
        r"\bmy passport experience\b", r"\bpassport experience\b", r"\bpassport memories\b",
        r"\bpassport memory\b", r"\bheart full of memories\b", r"\bfull of stamps\b",
    ],
}
CATEGORY_INPUT_CHARS = 512

# --- fixed values: region keywords, first region with a keyword wins ---------------------
REGION_KEYWORDS = {
    "India": [
        "india", "indian", "bharat", "passport seva", "passport seva kendra", "psk", "rpo",
        "new delhi", "delhi", "mumbai", "bombay", "punjab", "jalandhar", "amritsar",
        "chandigarh", "ludhiana", "bangalore", "bengaluru", "hyderabad", "kolkata", "chennai",
        "ahmedabad", "pune",
    ],
    "UnitedStates": [
        "united states", "united states of america", "usa", "u.s.a", "u.s.", "us", "american",
        "america", "washington dc", "new york", "california", "texas", "florida",
    ],
    "UnitedKingdom": [
        "united kingdom", "great britain", "uk", "u.k.", "britain", "british", "england",
        "scotland", "wales", "northern ireland", "london", "manchester",
    ],
    "Canada": ["canada", "canadian", "toronto", "vancouver", "ontario", "montreal"],
    "Australia": [
        "australia", "australian", "sydney", "melbourne", "brisbane", "perth", "canberra",
    ],
    "Russia": ["russia", "russian", "moscow", "st petersburg", "saint petersburg"],
    "France": ["france", "french", "paris"],
    "Germany": ["germany", "german", "berlin", "munich"],
    "Spain": ["spain", "spanish", "madrid", "barcelona"],
    "China": ["china", "chinese", "beijing", "shanghai", "hong kong"],
    "Japan": ["japan", "japanese", "tokyo"],
    "UnitedArabEmirates": ["united arab emirates", "uae", "u.a.e", "dubai", "abu dhabi"],
    "Singapore": ["singapore", "singaporean"],
    "NewZealand": ["new zealand", "new zealander", "auckland", "wellington"],
    "Italy": ["italy", "italian", "rome", "milan"],
    "Pakistan": ["pakistan", "pakistani", "islamabad", "karachi", "lahore"],
    "Bangladesh": ["bangladesh", "bangladeshi", "dhaka"],
    "Nepal": ["nepal", "nepali", "kathmandu"],
}

# --- fixed values: domain stop words of the shared-term test -----------------------------
CLUSTER_STOP_WORDS = (
    "passport passports travel travelling traveling visa visas country countries international "
    "people person help question advice information official online today new need needed like "
    "know want using use got get getting apply application"
).split()

# --- fixed values: stop words of the summary tokens --------------------------------------
SUMMARY_STOP_WORDS = (
    "the and that this with from have has had for are was were been being into about just they "
    "them their there here what when where which will would could should you your our but not "
    "who how why can also more than then only very its it's his her she him all get got one out "
    "now some any because been over after before much many"
).split()

# --- own small sentiment lexicon and the negators that flip the next word ----------------
# A full lexicon can be passed as a table; the labels depend on the lexicon given.
LEXICON = {
    4: "amazing awesome brilliant fantastic wonderful outstanding",
    3: "best excellent great happy love loved perfect impressive delighted winner",
    2: "good helpful nice thanks thank congrats success successful welcome approved enjoy "
       "friendly safe hope proud recommend improved",
    1: "easy fast cool like free ok clear quick smooth agree yes fine want",
    -1: "cancelled delay delayed stop stopped expired problem issue slow missing stuck wait "
        "unclear leave no",
    -2: "trouble warning sad sorry lost wrong fake failed fail denied rejected refused error "
        "mistake frustrated frustrating annoyed confused pain poor banned",
    -3: "bad angry awful worst terrible horrible hate scammer stolen worry worried violent kill",
    -4: "fraud scam scams catastrophic torture",
}
NEGATORS = (
    "cant can't dont don't doesnt doesn't not non wont won't isnt isn't"
).split()
