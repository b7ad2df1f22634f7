"""Word lists and patterns of the text operators. All are fixed values; operators take others as parameters."""

from __future__ import annotations

# Nicknames and the names they stand for.
NICKNAMES = {
    "bill": "william", "billy": "william", "will": "william", "willie": "william",
    "bob": "robert", "bobby": "robert", "rob": "robert",
    "dick": "richard", "rick": "richard", "richie": "richard",
    "jim": "james", "jimmy": "james", "jamie": "james",
    "joe": "joseph", "joey": "joseph",
    "jack": "john", "johnny": "john", "jon": "john",
    "tom": "thomas", "tommy": "thomas",
    "tony": "anthony",
    "ed": "edward", "eddie": "edward", "ted": "edward", "teddy": "edward",
    "harry": "henry", "hank": "henry",
    "fred": "frederick", "freddie": "frederick",
    "charlie": "charles", "chuck": "charles",
    "mike": "michael", "mickey": "michael",
    "dave": "david",
    "steve": "stephen", "stevie": "stephen",
    "sam": "samuel",
    "ben": "benjamin",
    "dan": "daniel", "danny": "daniel",
    "matt": "matthew",
    "nick": "nicholas",
    "pat": "patrick",
    "ron": "ronald", "ronnie": "ronald",
    "don": "donald", "donnie": "donald",
    "walt": "walter",
    "gus": "augustus",
    "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "marge": "margaret",
    "betty": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "bess": "elizabeth", "eliza": "elizabeth",
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "cathy": "katherine",
    "sue": "susan", "susie": "susan",
    "nan": "nancy", "nancy": "ann",
    "dot": "dorothy", "dottie": "dorothy",
    "jenny": "jennifer", "jen": "jennifer",
    "molly": "mary", "polly": "mary", "may": "mary", "mae": "mary",
    "sally": "sarah", "sadie": "sarah",
    "fanny": "frances", "fran": "frances",
    "gerry": "geraldine", "jerry": "gerald",
    "millie": "mildred",
    "winnie": "winifred",
    "minnie": "wilhelmina",
}
# Honorifics and suffixes that are no part of a name.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "phd", "md", "dr", "mr", "mrs", "ms", "sir", "dame"]
# Words that no person's name holds.
NO_NAMES = [
    "the", "a", "an", "at", "to", "for", "of", "in", "on", "by", "is", "are", "was",
    "this", "that", "these", "those", "where", "when", "how", "why", "who", "what",
    "away", "here", "there", "from", "with", "and", "or", "but", "as", "into",
    "live", "lives", "living", "diet", "birthday", "turning", "celebrates", "celebrate",
    "extraordinary", "amazing", "distinguished", "visitors", "editors", "editor",
    "cafe", "county", "coffee", "nation", "uncovers", "airman", "court", "least",
    "centenarian", "centenarians", "supercentenarian", "oldest", "secret", "secrets",
    "happy", "world", "news", "report", "story", "exclusive", "obituary", "tribute",
    "woman", "man", "lady", "gentleman", "people", "person", "years", "year", "old",
    "yorker", "today", "yesterday", "monday", "tuesday", "wednesday", "thursday",
    "friday", "saturday", "sunday",
]

# Traits as pattern, name, category.
TRAITS = [
    (r"\byoga\b", "yoga", "physical_activity"),
    (r"\bpilates\b", "pilates", "physical_activity"),
    (r"\b(walk|walking|walks)\b", "walking daily", "physical_activity"),
    (r"\b(run|running|runner|marathon|jog|jogging)\b", "running/marathon", "physical_activity"),
    (r"\bswim(ming|s)?\b", "swimming", "physical_activity"),
    (r"\b(cycl|bik(e|ing)|bicycle)\w*\b", "cycling", "physical_activity"),
    (r"\b(dance|dancing|dancer)\b", "dancing", "physical_activity"),
    (r"\b(gym|weight\s?lift|exercise|exercising|workout|work out)\w*\b", "regular exercise", "physical_activity"),
    (r"\b(garden|gardening)\b", "gardening", "physical_activity"),
    (r"\b(tai\s?chi|qigong|qi gong)\b", "tai chi", "physical_activity"),
    (r"\b(spin class|spinning class|spin classes)\b", "spin classes", "physical_activity"),
    (r"\b(stretch|stretching)\b", "stretching", "physical_activity"),
    (r"\b(golf|golfing)\b", "golf", "physical_activity"),
    (r"\b(active|activity|stay active|keep active|keeping active)\b", "staying active", "physical_activity"),
    (r"\bvegetarian\b", "vegetarian diet", "diet"),
    (r"\bvegan\b", "vegan diet", "diet"),
    (r"\b(vegetable|veggies|greens)\b", "eats vegetables", "diet"),
    (r"\bfruit\b", "eats fruit", "diet"),
    (r"\bfish\b", "eats fish", "diet"),
    (r"\boatmeal|porridge|oats\b", "oatmeal/porridge", "diet"),
    (r"\beggs?\b", "eats eggs", "diet"),
    (r"\b(olive oil)\b", "olive oil", "diet"),
    (r"\bbeans?\b|\blegumes?\b", "beans/legumes", "diet"),
    (r"\b(rice)\b", "rice staple", "diet"),
    (r"\b(home\s?cook|home-cooked|cook(s|ing)? (her|his|their) own)\b", "home cooking", "diet"),
    (r"\b(moderation|small portion|eat less|never overeat|portion)\b", "eating in moderation", "diet"),
    (r"\b(no junk|avoid(s|ed)? processed|no processed|whole food)\b", "avoids processed food", "diet"),
    (r"\b(chocolate)\b", "chocolate", "diet"),
    (r"\b(coffee)\b", "coffee", "diet"),
    (r"\b(tea)\b", "tea", "diet"),
    (r"\b(honey)\b", "honey", "diet"),
    (r"\b(bacon)\b", "bacon", "diet"),
    (r"\b(sugar|sweets|candy)\b", "sweets/sugar", "diet"),
    (r"\b(no alcohol|never drank|never drink|teetotal|don't drink|doesn't drink|abstain)\w*\b", "no alcohol", "substance_use"),
    (r"\b(wine|whisk(e)?y|beer|gin|brandy|sherry|rum|vodka|drink (a|the) )\w*\b", "drinks alcohol (moderate)", "substance_use"),
    (r"\b(never smoked|no smoking|don't smoke|doesn't smoke|non-smoker|nonsmoker|never smoke)\b", "never smoked", "substance_use"),
    (r"\b(smok(e|es|ed|ing)|cigarette|cigar|tobacco|pipe)\b", "smoked", "substance_use"),
    (r"\b(married)\b", "married (long)", "social"),
    (r"\b(family|families)\b", "close family", "social"),
    (r"\b(grandchild|grandchildren|great-grand|grandkids)\b", "grandchildren", "social"),
    (r"\b(friends?|friendship)\b", "friendships", "social"),
    (r"\b(community|neighbou?rs?)\b", "community ties", "social"),
    (r"\b(church|temple|mosque|synagogue|congregation)\b", "religious community", "social"),
    (r"\b(social|sociali[sz]|gathering|visit|company)\w*\b", "socializing", "social"),
    (r"\b(volunteer|volunteering|charity)\b", "volunteering", "social"),
    (r"\b(faith|god|religion|religious|pray|prayer|spiritual|belief)\w*\b", "faith/religion", "purpose_psychology"),
    (r"\b(positive|optimis|happy|happiness|cheerful|joy)\w*\b", "positive outlook", "purpose_psychology"),
    (r"\b(purpose|meaning|reason to)\w*\b", "sense of purpose", "purpose_psychology"),
    (r"\b(read|reads|reading|book)\w*\b", "reads daily", "purpose_psychology"),
    (r"\b(no stress|stress-free|don't worry|doesn't worry|never worry|no worries|stay calm|keep calm|calm)\b", "low stress / calm", "purpose_psychology"),
    (r"\b(grateful|gratitude|thankful)\b", "gratitude", "purpose_psychology"),
    (r"\b(curious|curiosity|learning|learn new)\b", "curiosity/learning", "purpose_psychology"),
    (r"\b(laugh|laughter|sense of humou?r|humou?r)\b", "humor/laughter", "purpose_psychology"),
    (r"\b(music|sing|singing|piano|choir|instrument)\b", "music", "purpose_psychology"),
    (r"\b(paint|painting|art|knit|knitting|craft|sew|sewing)\w*\b", "creative hobbies", "purpose_psychology"),
    (r"\b(puzzle|crossword|sudoku|cards|chess|bingo)\b", "puzzles/games", "purpose_psychology"),
    (r"\b(still work|still working|never retired|keep working|kept working|won't retire|works every)\b", "still working", "work_activity"),
    (r"\b(busy|keep busy|stay busy|keeping busy)\b", "keeping busy", "work_activity"),
    (r"\b(independent|live(s)? alone|lives independently|on her own|on his own)\b", "lives independently", "work_activity"),
    (r"\b(sleep|sleeps|slept)\b", "good sleep", "sleep"),
    (r"\b(nap|naps|napping|siesta)\b", "naps", "sleep"),
    (r"\b(early (to bed|riser|rise)|wake(s)? up early|up at dawn|go to bed early)\b", "early to bed/rise", "sleep"),
    (r"\b(eight hours|8 hours|full night|good night's)\b", "8 hours sleep", "sleep"),
]
# Tags of documents that count as traits: name, category.
TAG_TRAITS = {
    "trait_physical_activity": ("[tagged] physically active", "physical_activity"),
    "trait_diet": ("[tagged] healthy/notable diet", "diet"),
    "trait_social": ("[tagged] socially connected", "social"),
    "trait_purpose_psychology": ("[tagged] sense of purpose / positive psychology", "purpose_psychology"),
    "trait_sleep": ("[tagged] notable sleep habits", "sleep"),
}

# What a long life is put down to; the group is the reason.
ATTRIBUTION = [
    r"(?i)\b(?:I|she|he|they)\s+attributes?\s+(?:my|her|his|the|their|it)?\s*(?:longevity|long\s+life|long\s+years|age)?\s*(?:to\s+)([^.;!?]{6,90})",
    r"(?i)\b(?:she|he|they)\s+credits?\s+([^.;!?]{6,90})\s+(?:for|with)\s+(?:her|his|their)?\s*(?:longevity|long\s+life|long\s+years|long\s+age)",
    r"(?i)\bcredits?\s+(?:her|his|their|my)\s+(?:long\s+life|longevity|long\s+years|long\s+age)\s+to\s+([^.;!?]{6,90})",
    r"(?i)\b(?:her|his|my|their)\s+secret\s+(?:to\s+(?:longevity|long\s+life|living\s+long|living\s+to\s+\d+)\s+)?(?:is|was|are|were)\s+([^.;!?]{6,90})",
    r"(?i)\battributed?\s+(?:her|his|their|the|it|my)\s+(?:longevity|long\s+life|long\s+years)\s+to\s+([^.;!?]{6,90})",
    r"(?i)\b(?:the\s+)?(?:key|secret|recipe|formula|reason)\s+(?:to|of|for|behind)\s+(?:her|his|their|my)\s+(?:long\s+life|longevity|long\s+years|long\s+age|long\s+\d+\s+years)\s+(?:is|was)\s+([^.;!?]{6,90})",
    r"(?i)\b(?:she|he|they)\s+says?\s+(?:her|his|their)\s+secret\s+(?:to\s+(?:longevity|long\s+life)\s+)?(?:is|was)\s+([^.;!?]{6,90})",
    r"(?i)\b(?:she|he|they)\s+(?:said|believes?|thinks?|claims?|stated)\s+(?:that\s+)?(?:her|his|their)\s+(?:longevity|long\s+life)\s+(?:is|was)?\s*(?:due\s+to|because\s+of|thanks\s+to|comes?\s+from)\s+([^.;!?]{6,90})",
    r"(?i)\b(?:she|he|they)\s+(?:lived|lives)\s+to\s+\d+\s+(?:by|because\s+of|thanks\s+to|due\s+to)\s+([^.;!?]{6,90})",
    r"(?i)\b(?:put|puts|putting)\s+(?:her|his|their)\s+(?:longevity|long\s+life|long\s+years)\s+down\s+to\s+([^.;!?]{6,90})",
    r"(?i)\b(?:thanks?|owes?)\s+(?:her|his|their)\s+(?:longevity|long\s+life|long\s+years|long\s+age)\s+to\s+([^.;!?]{6,90})",
]

# Constructs that a corpus is screened for.
CONSTRUCTS = {
    "parental/offspring longevity": r"(?i)parental longevity|offspring of centenarian|familial longevity|long-lived (parent|famil)",
    "hearing": r"(?i)hearing (loss|impairment)|audiometr|presbycusis",
    "vision": r"(?i)vision (loss|impairment)|visual acuity|cataract|macular degeneration",
    "oral/periodontal": r"(?i)periodont|tooth loss|edentulous|oral health|dental",
    "sleep apnea": r"(?i)sleep apn('|o)ea|OSA|sleep-disordered breathing",
    "cardiorespiratory fitness": r"(?i)VO2 ?max|cardiorespiratory fitness|aerobic capacity",
    "gait/walking speed": r"(?i)gait speed|walking speed|usual pace",
    "education/SES": r"(?i)educational attainment|socioeconomic|income|years of education",
    "vitamin D": r"(?i)vitamin ?d|25-?hydroxyvitamin",
    "hearing aid/prosthetic (anti-signal check)": r"(?i)hearing aid|prosthe(sis|tic)|wheelchair",
}

# Stretches that scraping leaves in news, removed wherever they stand, in this order.
JUNK_SUBSTRINGS = [
    "lessdisplay advertising",
    "fromlocal businessespromotinglocal service",
    "fromlocal businesses",
    "promotinglocal service",
    "promotinglocal",
    "thelocal community",
    "piano meteractive meterexpired callbackevent",
    "piano meteractive meterexpired",
    "piano meteractive",
    "meteractive meterexpired",
    "meterexpired callbackevent",
    "callbackevent",
    "useandprivacy policy",
    "useandprivacy",
    "lively civil forum",
    "more lessdisplay",
    "challenge time",
    "community guidelines",
    "ourcommunity guidelines",
    "ourcommunity guidelinesfor",
    "agree ourterms",
    "agree to ourterms",
    "follow comments",
    "follow comment",
    "you follow comments",
    "comment relevant respectful",
    "lively civil forum maintain",
    "maintain lively civil forum",
    "promote advert",
    "promotional advert",
    "receive email",
    "newsletter signup",
    "subscribe button",
    "challenging times",
    "during these challenging",
    "need challenge time",
    "need support possible",
    "need as much support as possible",
    "as much support as possible during these challenging",
    "challenging times as much support as possible",
    "great reading every saturday",
    "big issues on wednesday",
    "agree to our terms",
    "trending now",
]
# Words that scraping glued together, and how they come apart.
GLUED = [
    (r"([a-z])([A-Z])", "$1 $2"),
    (r"(?i)\bandobesity\b", "and obesity"),
    (r"(?i)\btobaccoas\b", "tobacco as"),
    (r"(?i)\bourterms\b", "our terms"),
    (r"(?i)\bourcommunity\b", "our community"),
    (r"(?i)\bGuidelinesfor\b", "Guidelines for"),
    (r"(?i)\bbusinessespromoting\b", "businesses promoting"),
    (r"(?i)\bmeteractive\b", "meter active"),
    (r"(?i)\bmeterexpired\b", "meter expired"),
    (r"(?i)\bcallbackevent\b", "callback event"),
    (r"\b(and|but|the|our|for|with)([A-Z][a-z]{3,})\b", "$1 $2"),
]
# Sentences with one of these are no part of an article.
BOILERPLATE = [
    r"\bwe use cookies\b",
    r"\bcookie (?:policy|notice|preferences|settings|consent)\b",
    r"\baccept (?:all )?cookies\b",
    r"\bby clicking (?:accept|i agree|agree)\b",
    r"\bthis (?:site|website|page) uses cookies\b",
    r"\b(?:enable|disable) cookies\b",
    r"\bmanage (?:cookie )?preferences\b",
    r"\bprivacy policy\b",
    r"\bterms of (?:service|use|conditions)\b",
    r"\ball rights reserved\b",
    r"\bcopyright\s+(?:©|\(c\)|\d{4})\b",
    r"\bsubscribe to (?:our )?(?:newsletter|email)\b",
    r"\b(?:daily|weekly|monthly|free) newsletter\b",
    r"\bsign up (?:for|to)\b(?:[^.!?]{0,40})\b(?:newsletter|updates|emails?)\b",
    r"\benter your email\b",
    r"\bemail (?:address )?required\b",
    r"\b(?:get|receive) (?:the )?latest (?:news|stories|updates)\b",
    r"\bdisplay advertising\b",
    r"\badvertisement\b",
    r"\bsponsored (?:content|by|post|article)\b",
    r"\bpromotional content\b",
    r"\btarget audience\b",
    r"\bsmall businesses?\s+(?:advertising|promote|reach)\b",
    r"\b(?:from\s+)?local businesses?\s+(?:promote|advertising|target)\b",
    r"\bdata ?layer\b",
    r"\bgoogle ?tag\b",
    r"\bwindow\.__\w+\b",
    r"\bdocument\.(?:getElementById|querySelector)\b",
    r"\bpiano meter\b",
    r"\bcomment policy\b",
    r"\bjoin the conversation\b",
    r"\bleave a comment\b",
    r"\bcomments? (?:below|section|are\s+closed)\b",
    r"\bshare (?:this article|on facebook|on twitter|on linkedin|via email)\b",
    r"\bfollow us on\s+(?:facebook|twitter|instagram|linkedin)\b",
    r"\btweet this\b",
    r"\bshare via\b",
    r"\bread more\b",
    r"\bcontinue reading\b",
    r"\brelated (?:articles?|stories|content|posts?)\b",
    r"\byou (?:may|might) also like\b",
    r"\btrending (?:now|today|this week)\b",
    r"\bmost (?:read|popular|viewed)\b",
    r"\beditor'?s picks?\b",
    r"\bskip to (?:main )?content\b",
    r"\b(?:main|primary|site) (?:menu|navigation)\b",
    r"\bsearch this site\b",
    r"\bquick links\b",
    r"\bsubscribe (?:today|now|for)\b",
    r"\bsubscribe for (?:unlimited|full)\b",
    r"\bpremium (?:content|article|subscriber|access)\b",
    r"\bfor subscribers only\b",
    r"\bfree trial\b",
    r"\b(?:create|register for) (?:an? )?account\b",
    r"\balready (?:a subscriber|registered)\b",
    r"\babout us\b\s*[\|·•]?\s*\bcontact us\b",
    r"\bcontact us\b\s*[\|·•]?\s*\babout us\b",
    r"\bcommunity guidelines?\b",
    r"\bfollow comments?\b",
    r"\bagree (?:to )?(?:our )?terms\b",
    r"\bkeep comments? (?:relevant|respectful|civil)\b",
    r"\bmaintain (?:a )?lively (?:civil )?forum\b",
    r"\bduring (?:these )?challenging times\b",
    r"\bas much support as possible\b",
    r"\bgreat reading (?:every )?(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\bbig issues on (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b",
    r"\bvisit (?:our )?community\b",
    r"\bget news (?:via|by) email\b",
    r"\breceive (?:our )?email\b",
    r"\b(?:moderator|moderation) (?:team|policy)\b",
    r"\bview comments?\b",
]

# Units of measured values.
UNITS = [
    "mg/dL", "mg/L", "g/dL", "g/L", "ng/mL", "pg/mL", "µg/mL", "μg/mL", "ug/mL", "mmol/L", "µmol/L", "μmol/L", "umol/L", "nmol/L", "pmol/L", "IU/L", "U/L", "U/mL",
    "mmHg", "mm Hg", "kg/m²", "kg/m2", "kg m-2", "bpm", "beats/min", "fL", "%", "percent", "×10⁹/L", "x10⁹/L", "10⁹/L", "x10^9/L", "10^9/L",
    "cells/mm³", "cells/mm3", "cells/µL", "cells/uL", "mL/kg/min", "mL/min/kg", "mL/min", "L/min", "kb", "bp",
]

# Words that end the way back from a value to its name.
NOT_IN_NAMES = [
    "year", "years", "age", "ages", "aged", "month", "months", "day", "days", "subject", "subjects", "patient", "patients", "participant",
    "participants", "control", "controls", "case", "cases", "group", "groups", "sample", "samples", "study", "studies", "result", "results",
    "individual", "individuals", "cohort", "cohorts", "data", "value", "values", "level", "levels", "score", "scores", "table", "figure", "abstract",
    "background", "method", "methods", "conclusion", "objective", "aim", "we", "the", "this", "that", "these", "those", "their", "his", "her", "of",
    "in", "to", "for", "with", "from", "by", "on", "at", "as", "between", "across", "among", "during", "after", "before", "within", "high", "low",
    "elevated", "reduced", "decreased", "increased", "higher", "lower", "greater", "lesser", "more", "less", "compared", "older", "younger", "old",
    "young", "above", "below", "least", "most", "first", "second", "third", "last", "next", "period", "baseline", "follow-up", "followup", "median",
    "mean", "average", "range", "iqr", "respectively", "overall", "general", "specific", "total", "subtotal", "trial", "trials", "review", "n", "p",
    "association", "associated", "associations", "increase", "decrease", "risk", "risks", "rate", "rates", "ratio", "ratios", "percent", "factor",
    "factors", "marker", "markers", "test", "tests", "examination", "examinations", "measurement", "measurements", "adults", "adult", "elderly",
    "centenarian", "centenarians", "nonagenarian", "nonagenarians", "supercentenarian", "supercentenarians", "people", "person", "persons", "men",
    "women", "male", "female", "community", "community-dwelling", "hospital", "hospitalized", "follow",
]

# Words that connect a value with its name.
CONNECTING = [
    "was", "were", "of", "in", "the", "a", "an", "is", "are", "with", "for", "had", "have", "has", "to", "and", "or", "than", "by", "on", "as", "from", "between", "across", "respectively",
    "value", "values", "level", "levels", "concentration", "concentrations", "count", "counts", "mean", "median", "average",
]

# Words one of which a biomarker's name holds.
BIOMEDICAL = [
    "cholesterol", "ldl", "hdl", "vldl", "lipid", "lipids", "lipoprotein", "triglyceride", "triglycerides", "apolipoprotein", "apoa", "apob",
    "glucose", "insulin", "hba1c", "a1c", "glycated", "glycohemoglobin", "homa", "homa-ir", "homeostatic", "crp", "c-reactive", "interleukin",
    "il-6", "il-1", "il-10", "il-8", "tnf", "tnf-alpha", "tnfalpha", "cytokine", "cytokines", "ferritin", "inflammatory", "inflammation",
    "fibrinogen", "hemoglobin", "haemoglobin", "hematocrit", "platelet", "platelets", "leukocyte", "leukocytes", "lymphocyte", "lymphocytes",
    "neutrophil", "neutrophils", "monocyte", "monocytes", "eosinophil", "wbc", "rbc", "mcv", "mch", "mchc", "rdw", "bmi", "mass", "weight", "height",
    "waist", "hip", "circumference", "systolic", "diastolic", "blood pressure", "pulse", "hr", "grip", "strength", "muscle", "lean", "fat",
    "adiposity", "igf", "igf-1", "igf1", "igfbp", "dhea", "dheas", "cortisol", "testosterone", "estrogen", "estradiol", "tsh", "t3", "t4", "thyroid",
    "growth hormone", "creatinine", "egfr", "gfr", "albumin", "cystatin", "urea", "bun", "uric", "alt", "ast", "ggt", "bilirubin", "alp", "calcium",
    "phosphate", "vitamin", "25-oh", "25(oh)d", "horvath", "phenoage", "grimage", "dunedinpace", "methylation", "epigenetic", "biological age",
    "telomere", "telomerase", "klotho", "sirtuin", "nad", "nad+", "p21", "p16", "apoe", "foxo3", "cetp", "mortality", "longevity", "survival",
    "lifespan", "hazard", "incidence", "prevalence", "morbidity", "hypertension", "diabetes", "stroke", "cancer", "dementia", "alzheimer",
    "alzheimer's", "frailty", "sarcopenia", "osteoporosis", "cardiovascular", "coronary", "myocardial", "marker", "biomarker", "panel", "score",
    "microbiome", "microbiota", "bacteroides", "firmicutes", "akkermansia", "bifidobacterium",
]

# Words of which no phrase consists.
JUNK_WORDS = [
    "study", "studies", "paper", "papers", "article", "articles", "result", "results", "finding", "findings", "analysis", "analyses", "method",
    "methods", "datum", "data", "sample", "samples", "group", "groups", "participant", "participants", "subject", "subjects", "patient", "patients",
    "individual", "individuals", "cohort", "cohorts", "population", "populations", "number", "percent", "percentage", "rate", "ratio", "odds",
    "hazard", "confidence", "interval", "value", "level", "mean", "average", "median", "range", "standard", "deviation", "regression", "model",
    "variable", "factor", "association", "relationship", "correlation", "effect", "impact", "logistic", "linear", "multivariate", "covariate",
    "adjusted", "unadjusted", "table", "figure", "conclusion", "introduction", "background", "aim", "objective", "author", "year", "month", "week",
    "day", "period", "follow", "control", "comparison", "age", "sex", "gender", "p-value", "ci", "news", "story", "stories", "reporter", "editor",
    "photo", "image", "video", "caption", "link", "click", "page", "site", "website",
]

# Concepts in order, each with its tier, category and keywords; the first with a keyword in a phrase is the phrase's.
CODEBOOK = {
    "physical_activity": (1, "lifestyle", ["physical activity", "exercise", "walking", "sedentary", "aerobic", "active lifestyle", "recreation", "vigorous", "moderate activity", "fitness", "sport"]),
    "smoking": (1, "lifestyle", ["smoking", "tobacco", "cigarette", "smoker", "nicotine", "never smoked", "non-smoker"]),
    "alcohol": (1, "lifestyle", ["alcohol", "drinking", "wine", "beer", "spirits", "drinker", "abstainer", "moderate drinking"]),
    "sleep": (1, "lifestyle", ["sleep", "insomnia", "sleep duration", "sleep quality", "napping", "circadian", "rest", "snore"]),
    "diet_nutrition": (1, "lifestyle", ["diet", "nutrition", "mediterranean", "plant-based", "vegetable", "fruit", "whole grain", "processed food", "eating habit", "food intake", "caloric"]),
    "social_connection": (1, "lifestyle", ["social", "marriage", "married", "loneliness", "isolation", "social network", "social support", "friendship", "community", "relationship"]),
    "education_cognitive": (2, "lifestyle", ["education", "cognitive", "intellectual", "learning", "reading", "literacy", "schooling"]),
    "occupation_retirement": (2, "lifestyle", ["retirement", "working", "occupation", "employment", "productive activity", "labor", "job"]),
    "inflammation_crp": (3, "biomarker", ["crp", "c-reactive protein", "inflammation", "inflammatory marker", "systemic inflammation", "chronic inflammation"]),
    "glucose_metabolism": (3, "biomarker", ["glucose", "fasting glucose", "blood glucose", "hba1c", "glycated hemoglobin", "glycemia", "glycemic", "insulin resistance", "prediabetes"]),
    "diabetes_status": (3, "biomarker", ["diabetes", "diabetic", "type 2 diabetes", "type ii diabetes"]),
    "cholesterol_lipids": (3, "biomarker", ["cholesterol", "ldl", "hdl", "lipid", "dyslipidemia", "lipoprotein", "total cholesterol"]),
    "triglycerides": (3, "biomarker", ["triglyceride", "trig"]),
    "blood_pressure": (3, "biomarker", ["blood pressure", "hypertension", "systolic", "diastolic", "hypertensive", "normotensive", "arterial pressure"]),
    "body_composition": (3, "biomarker", ["body mass index", "bmi", "body weight", "obesity", "overweight", "underweight", "adiposity", "waist", "body composition", "muscle mass", "lean mass", "sarcopenia"]),
    "immune_blood": (3, "biomarker", ["immune", "lymphocyte", "neutrophil", "white blood cell", "leukocyte", "immunity", "wbc", "platelet"]),
    "anemia_red_cells": (3, "biomarker", ["hemoglobin", "red blood cell", "anemia", "hematocrit", "rbc"]),
    "telomere_length": (3, "biomarker", ["telomere", "telomerase", "telomere length", "leukocyte telomere"]),
    "epigenetic_methylation": (3, "biomarker", ["methylation", "dna methylation", "epigenetic", "epigenome", "epigenetic clock", "horvath", "phenoage", "grimage"]),
    "microbiome_gut": (3, "biomarker", ["microbiome", "gut microbiota", "gut bacteria", "microbiota", "gut flora"]),
    "kidney_function": (3, "biomarker", ["creatinine", "kidney function", "gfr", "egfr", "renal function", "cystatin"]),
    "apoe_gene": (3, "genomic", ["apoe", "apolipoprotein e", "apoe4", "apoe2", "apoe3", "e4 allele"]),
    "foxo3_gene": (3, "genomic", ["foxo3", "foxo", "forkhead box"]),
    "longevity_snps": (3, "genomic", ["longevity snp", "gwas longevity", "longevity locus", "longevity allele", "centenarian genome"]),
    "mtor_pathway": (3, "genomic", ["mtor", "rapamycin", "mtorc1", "tor signaling"]),
    "sirtuin_nad": (3, "genomic", ["sirtuin", "sirt1", "sirt3", "sirt6", "nad+", "nicotinamide"]),
    "mitochondrial": (3, "genomic", ["mitochondria", "mitochondrial dna", "mtdna", "mitochondrial function", "haplogroup"]),
}

# Canonical names of biomarkers in order, each with what a raw name holds.
CANONICAL = [
    ("all_cause_mortality", ["all-cause mortality", "all cause mortality"]),
    ("cardiovascular_mortality", ["cardiovascular mortality", "cvd mortality", "morir por causas cardiovascular", "causas cardiovasculares"]),
    ("coronary_heart_disease", ["coronary heart disease"]),
    ("hdl_cholesterol", ["hdl cholesterol"]),
    ("breast_cancer", ["breast cancer"]),
    ("prostate_cancer", ["prostate cancer"]),
    ("skin_cancer", ["skin cancer"]),
    ("myocardial_infarction", ["myocardial infarction"]),
    ("estimated_glomerular_filtration_rate", ["estimated glomerular filtration"]),
    ("c_reactive_protein", ["c-reactive protein", "creactive protein"]),
    ("interleukin_6", ["interleukin-6", "interleukin 6", "il-6"]),
    ("igf_1", ["insulin-like growth factor", "igf-1", "igf 1", "igfbp"]),
    ("thyroid_stimulating_hormone", ["thyroid stimulating hormone"]),
    ("subclinical_hypothyroidism", ["subclinical hypothyroidism"]),
    ("subclinical_hyperthyroidism", ["subclinical hyperthyroidism"]),
    ("hyperthyroidism", ["overt hyperthyroidism", "hyperthyroidism"]),
    ("hypothyroidism", ["hypothyroidism"]),
    ("euthyroid", ["euthyroid"]),
    ("diabetes", ["diabetes mellitus", "type diabetes", "diabetes t2d", "t2d", "diabetes"]),
    ("hypertriglyceridemia", ["hypertriglyceridemia"]),
    ("triglycerides", ["triglycerid"]),
    ("body_mass_index", ["body mass index", "bmi"]),
    ("waist_circumference", ["waist circumference"]),
    ("calf_circumference", ["calf circumference"]),
    ("grip_strength", ["handgrip strength", "grip strength", "grip"]),
    ("muscle_strength", ["limb muscle strength", "muscle strength"]),
    ("muscle_mass", ["muscle mass"]),
    ("frailty", ["physical frailty", "developing frailty", "frailty"]),
    ("pre_frailty", ["pre-frailty", "prefrailty", "pre frailty"]),
    ("sarcopenia", ["sarcopenia"]),
    ("hip_osteoarthritis", ["hip oa", "hip osteoarthritis"]),
    ("osteoporosis", ["osteoporosis"]),
    ("multimorbidity", ["multimorbidity"]),
    ("comorbidity", ["comorbidity"]),
    ("metabolic_syndrome", ["mets prevalence", "metabolic syndrome"]),
    ("left_ventricular_diastolic_dysfunction", ["lv diastolic dysfunction", "diastolic dysfunction"]),
    ("cardiovascular_disease", ["incident cvd", "cardiovascular disease", "cardiovascular causes", "cardiovascular symptoms", "cardiovascular benefits", "cardiovascular", "cardiovasculares", "cardiovascular benef"]),
    ("alzheimer_disease", ["alzheimer"]),
    ("dementia", ["dementia"]),
    ("depression", ["depression"]),
    ("stroke", ["stroke"]),
    ("telomere_length", ["telomere length"]),
    ("telomerase", ["telomerase"]),
    ("epigenetic_age", ["epigenetic age"]),
    ("systolic_blood_pressure", ["systolic blood pressure"]),
    ("diastolic_blood_pressure", ["diastolic blood pressure"]),
    ("blood_pressure", ["blood pressure"]),
    ("hypertension", ["hypertension"]),
    ("cholesterol", ["cholesterol"]),
    ("cortisol", ["cortisol"]),
    ("testosterone", ["testosterone"]),
    ("albumin", ["albumin"]),
    ("serum_urea", ["serum urea", "urea"]),
    ("white_blood_cell", ["white blood cell"]),
    ("dheas", ["dheas", "dhea"]),
    ("tnf_alpha", ["tnf"]),
    ("inflammation", ["inflammation"]),
    ("vitamin", ["vitamin"]),
    ("weight_loss", ["weight loss"]),
    ("underweight", ["underweight"]),
    ("insulin", ["insulin"]),
    ("activities_of_daily_living", ["adl", "activities of daily"]),
    ("lifespan", ["lifespan"]),
    ("longevity", ["longevity"]),
    ("all_cause_morbidity", ["morbidity"]),
    ("survival", ["survival"]),
    ("mortality", ["mortality"]),
    ("cancer", ["cancer"]),
    ("diet", ["diet"]),
]

# Phrases that are stripped from names without a canonical one.
STRIPPED_PHRASES = [
    "multivariate analysis", "confidence interval", "all-cause", "hr ci", "ci ", " ci", " hr", "hr ", " ivw", "ivw ", " pd", "pd ", " adj",
    "mmse adj", "nhanes",
]

# Words that are stripped from them.
STRIPPED_WORDS = [
    "multivariate", "analysis", "specifically", "without", "develop", "developing", "predicted", "predictor", "pooled", "almost", "fold",
    "quartiles", "raised", "reducing", "lowest", "usual", "early", "strongest", "including", "components", "component", "category", "ivw", "hr",
    "ci", "or", "confidence", "interval", "pd", "adj", "mmse", "scored", "each", "was", "showed", "had", "response", "selection", "status", "stage",
    "strata", "seldom", "loneliness", "youthful", "brain", "top", "both", "parents", "corresponding", "requirement", "daily", "grs", "sup", "the",
    "and", "but", "not", "con", "por", "de",
]

# Raw names that are no biomarker and are dropped.
DROPPED_NAMES = [
    "each component was scored", "each scored", "hr ci", "both parents top survival", "response had survival benefit", "weighting but not diabetes",
    "stroke hr ci depression", "pd hr ci depression",
]

# Raw names that are garbage.
GARBAGE_NAMES = [
    "each component was scored", "each scored", "hr ci", "both parents top survival", "response had survival benefit", "weighting but not diabetes",
]

# Raw names that could be several.
AMBIGUOUS_NAMES = [
    "stroke hr ci depression", "pd hr ci depression", "weighting but not diabetes", "mortality including glucose",
]

# What names in other languages hold.
FOREIGN_PARTS = [
    "asociaron", "associados", "benef cios", "morir", "riscos", "desfechos", "causas cardiovasculares",
]

# Words and stems that papers use for a trait.
SYNONYMS = {
    "close family": ["close family", "family", "relatives", "children", "grandchildren"],
    "friendships": ["friendship", "friends", "social network", "peer relationship"],
    "socializing": ["socializing", "social engagement", "social participation"],
    "positive outlook": ["positive outlook", "optimism", "positive attitude", "wellbeing", "well-being", "happiness"],
    "reads daily": ["reading", "cognitive engagement", "intellectual activity"],
    "creative hobbies": ["hobbies", "creative activit", "arts", "crafts"],
    "faith/religion": ["religion", "religious", "spirituality", "church"],
    "community ties": ["community", "volunteering", "civic engagement"],
    "walking daily": ["walking", "ambulatory activity", "steps"],
    "drinks alcohol (moderate)": ["alcohol", "drinking", "wine", "moderate drink"],
    "regular exercise": ["exercise", "physical activity", "fitness training"],
    "staying active": ["active lifestyle", "physical function"],
    "grandchildren": ["grandchildren", "grandchild", "family"],
    "humor/laughter": ["humor", "laughter", "sense of humor"],
    "dancing": ["dance", "dancing"],
    "volunteering": ["volunteer", "volunteering", "community service"],
    "married (long)": ["marriage", "married", "spouse", "partnership"],
    "running/marathon": ["running", "jogging", "aerobic exercise", "marathon"],
    "puzzles/games": ["cognitive activit", "puzzles", "games", "mental exercise"],
    "religious community": ["religious community", "church community", "congregation"],
    "lives independently": ["independent living", "independence", "autonomy"],
    "chocolate": ["chocolate", "cocoa", "flavonoid"],
    "eats eggs": ["eggs", "dietary protein"],
    "music": ["music", "musical activity", "singing"],
}

# Fixed value: what a paper on long lives holds.
LONG_LIVES = (
    r"(?i)"
    r"centenarian|supercentenarian|longevity|lifespan|long[-\s]lived"
)

# Fixed value: what shows that a word beside it describes a study's design.
DESIGN = (
    r"(?i)"
    r"community[-\s]?(?:dwelling|based|residing|living)|population[-\s]?based|"
    r"hospital[-\s]?based|family histor|in the community|"
    r"study (?:sample|population|participants|cohort|setting)|recruit|enroll|"
    r"inclusion criteria|baseline characteristics|disease activity|"
    r"active (?:comparator|surveillance|disease|control)|family (?:practice|medicine)|"
    r"children (?:in|of) the (?:study|cohort|sample)|number of children"
)

# Countries by parts of a URL, the first that it holds; other .com sites count as USA.
DOMAIN_COUNTRIES = {
    ".com.au": "Australia", ".co.nz": "New Zealand", ".ca": "Canada", ".co.uk": "UK", ".co.za": "South Africa", ".co.ke": "Kenya",
    ".com.ng": "Nigeria", ".co.in": "India", ".com.sg": "Singapore", ".co.jp": "Japan", ".co.kr": "South Korea", ".com.hk": "Hong Kong",
    ".com.ph": "Philippines", ".co.th": "Thailand", ".com.my": "Malaysia", ".fr": "France", ".de": "Germany", ".es": "Spain", ".it": "Italy",
    ".pt": "Portugal", ".nl": "Netherlands", ".se": "Sweden", ".dk": "Denmark", ".no": "Norway", ".fi": "Finland", ".gr": "Greece", ".ie": "Ireland",
    ".be": "Belgium", ".ch": "Switzerland", ".pl": "Poland", ".cz": "Czech Republic", ".hu": "Hungary", ".ro": "Romania", ".tr": "Turkey",
    ".ru": "Russia", ".br": "Brazil", ".ar": "Argentina", ".mx": "Mexico", ".cl": "Chile", ".co": "Colombia", ".pe": "Peru", ".il": "Israel",
    ".ae": "UAE", ".sa": "Saudi Arabia", ".qa": "Qatar", ".cu": "Cuba", ".cr": "Costa Rica", "bbc.com": "UK", "theguardian.com": "UK",
    "dailymail.co.uk": "UK", "cnn.com": "USA", "nytimes.com": "USA", "washingtonpost.com": "USA", "today.com": "USA", "foxnews.com": "USA",
    "nbcnews.com": "USA", "aarp.org": "USA", "people.com": "USA", "time.com": "USA", "bluezones.com": "USA", "reuters.com": "International",
    "apnews.com": "International", "aljazeera.com": "Qatar", "scmp.com": "Hong Kong",
}

# Countries by parts of a news source's name.
SOURCE_COUNTRIES = {
    "bbc": "UK", "guardian": "UK", "telegraph": "UK", "daily mail": "UK", "independent": "UK", "mirror": "UK", "sun": "UK", "sky news": "UK",
    "times": "UK", "scotsman": "UK", "cnn": "USA", "nbc": "USA", "cbs": "USA", "abc news": "USA", "fox": "USA", "nyt": "USA",
    "new york times": "USA", "washington post": "USA", "today": "USA", "time": "USA", "people": "USA", "aarp": "USA", "npr": "USA",
    "usa today": "USA", "newsweek": "USA", "reuters": "International", "ap news": "International", "cbc": "Canada", "globe and mail": "Canada",
    "toronto star": "Canada", "national post": "Canada", "abc australia": "Australia", "sydney morning": "Australia", "the age": "Australia",
    "sbs": "Australia", "nine news": "Australia", "herald sun": "Australia", "news.com.au": "Australia", "le monde": "France", "le figaro": "France",
    "liberation": "France", "spiegel": "Germany", "welt": "Germany", "zeit": "Germany", "el pais": "Spain", "el mundo": "Spain",
    "repubblica": "Italy", "corriere": "Italy", "stampa": "Italy", "times of india": "India", "hindu": "India", "ndtv": "India",
    "hindustan times": "India", "japan times": "Japan", "nikkei": "Japan", "mainichi": "Japan", "yomiuri": "Japan", "asahi": "Japan",
    "scmp": "Hong Kong", "south china": "Hong Kong", "straits times": "Singapore", "channel news": "Singapore", "korea herald": "South Korea",
    "joong": "South Korea", "nz herald": "New Zealand", "stuff": "New Zealand", "irish times": "Ireland", "rte": "Ireland", "haaretz": "Israel",
    "jerusalem post": "Israel", "al jazeera": "Qatar", "news24": "South Africa", "iol": "South Africa", "daily nation": "Kenya",
    "premium times": "Nigeria", "globo": "Brazil", "folha": "Brazil", "infobae": "Argentina", "nacion": "Argentina",
}

# Countries by their two-letter codes in news records.
CODE_COUNTRIES = {
    "US": "USA", "UK": "UK", "CA": "Canada", "AS": "Australia", "NZ": "New Zealand", "IN": "India", "CH": "China", "JA": "Japan",
    "KS": "South Korea", "GM": "Germany", "FR": "France", "SP": "Spain", "IT": "Italy", "NL": "Netherlands", "SW": "Sweden", "DA": "Denmark",
    "FI": "Finland", "NO": "Norway", "PO": "Portugal", "GR": "Greece", "BE": "Belgium", "EI": "Ireland", "TU": "Turkey", "IS": "Israel",
    "SA": "Saudi Arabia", "AE": "UAE", "QA": "Qatar", "PK": "Pakistan", "SF": "South Africa", "NI": "Nigeria", "KE": "Kenya", "BR": "Brazil",
    "AR": "Argentina", "MX": "Mexico", "CI": "Chile", "CO": "Colombia", "PE": "Peru", "SN": "Singapore", "TH": "Thailand", "MY": "Malaysia",
    "ID": "Indonesia", "VM": "Vietnam", "RP": "Philippines", "RS": "Russia", "PL": "Poland", "HU": "Hungary", "RO": "Romania",
    "EZ": "Czech Republic", "AU": "Austria", "SZ": "Switzerland", "CU": "Cuba", "CS": "Costa Rica", "BL": "Bolivia", "HK": "Hong Kong",
    "TW": "Taiwan",
}

# Ages of people in context, first kind first.
PERSON_AGES = [
    r"\b(\d{2,3})[- ]year[s]?[- ]old\b",
    r"\baged?\s+(\d{2,3})\b",
    r"\bat\s+(?:the\s+)?age\s+of\s+(\d{2,3})\b",
    r"\b(\d{2,3})\s+years?\s+old\b",
    r"\bwho\s+(?:was|is|turned?)\s+(\d{2,3})\b",
    r"\bturned?\s+(\d{2,3})\b",
    r"\bcentenarian\s+(?:aged?|who\s+is)\s+(\d{2,3})\b",
    r"\bsupercentenarian\s+aged?\s+(\d{2,3})\b",
]
# The ages that count, and how far a name may be from one.
LEAST_AGE, LARGEST_AGE, FARTHEST_NAME = 95, 135, 600

# Cues of a direction, the first of equally many wins.
CUES = {
    "high": r"\b(?:high|elevated|increased?|raised?|greater|higher|excessive|hyper)\b",
    "low": r"\b(?:low|reduced?|decreased?|less|lower|deficient|deficiency|hypo|under|lack of)\b",
    "never": r"\b(?:never|no|without|non[- ]?|abstain|free of|absence of)\b",
    "moderate": r"\b(?:moderate|balanced|adequate|controlled|managed|optimal|normal|stable)\b",
}

# What mentions a comparison, and a percentage beside it.
COMPARED = r"control|comparison group|non[-\s]?centenarian"
CONTROL_PERCENT = r"(?:control[s]?[^.]{0,60}?(\d{1,2}(?:\.\d)?)\s?%)|(\d{1,2}(?:\.\d)?)\s?%[^.]{0,40}?control"

#: English function words; no phrase holds one.
FUNCTION_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between", "both", "but", "by",
    "can", "could", "did", "do", "does", "doing", "down", "during", "each", "either", "else", "even", "ever", "every", "few", "for", "from", "further", "had", "has", "have", "having", "he", "her", "here",
    "hers", "herself", "him", "himself", "his", "how", "however", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "may", "me", "might", "more", "most", "must", "my", "myself", "neither", "no",
    "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "ours", "out", "over", "own", "per", "quite", "rather", "same", "shall", "she", "should", "since", "so", "some", "such",
    "than", "that", "the", "their", "theirs", "them", "then", "there", "these", "they", "this", "those", "though", "through", "thus", "to", "too", "under", "until", "up", "upon", "us", "very", "was", "we",
    "were", "what", "when", "where", "whether", "which", "while", "who", "whom", "whose", "why", "will", "with", "within", "without", "would", "yet", "you", "your", "yours",
]
# Words that look like several run together.
RUN_TOGETHER = ["[bcdfghjklmnpqrstvwxz]{5,}", "^(?:and|but|the|our|for|with|from|that)[a-z]{4,}"]

# Where a trait's share of the population is known from, by what its name or its category says.
SURVEY_BY_NAME = {"smok": "nhanes_smoking", "alcohol": "nhanes_alcohol", "drink": "nhanes_alcohol"}
SURVEY_BY_CATEGORY = {"physical_activity": "nhanes_physical_activity", "sleep": "nhanes_sleep"}
WHO_BY_CATEGORY = {"physical_activity": "physical inactivity"}
WHO_BY_NAME = {"alcohol": "alcohol use", "drink": "alcohol use"}

# Mentions of smoking, and what is told in their windows.
SMOKE = r"(?i:\b(?:smok\w*|cigarette\w*|cigar\b|cigars\b|pipe\b|tobacco|pack[-\s]?year)\w*)"
SMOKING = {
    n: f"(?i){p}"
    for n, p in {
        "status_never": r"never\s+smok|non[-\s]?smoker|did\s?n[o']t\s+smoke|didnt smoke",
        "status_former": r"(?:quit|gave up|stopped|ceased|former\s+smoker|used to smoke)",
        "status_current": r"(?:still\s+smok|smokes?\s+(?:daily|every|a)|continues? to smoke|a[-\s]?day habit)",
        "amount_cigs": r"\d+\s*(?:cigarettes?|cigs?)\s*(?:a|per)?\s*day",
        "amount_packs": r"\d+(?:\.\d+)?\s*pack",
        "duration_years": r"smok\w*\s+for\s+\d+\s+years|\d+\s+years?\s+of\s+smok",
        "cessation_quit_age": r"(?:quit|stopped|gave up).{0,30}?(?:at|aged|age)\s+\d+",
        "cessation_years_since": r"(?:quit|stopped|gave up).{0,30}?\d+\s+years\s+(?:ago|earlier|before)",
        "type_pipe": r"\bpipe\b",
        "type_cigar": r"\bcigars?\b",
        "type_occasional": r"occasional\w*\s+(?:smok|cigar)",
    }.items()
}
