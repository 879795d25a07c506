"""Fixed values shared by operators and by the SQL counterparts."""

# The short function-word list used when keywords are counted.
COMMON_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be have has had do does did "
    "will would could should may might must shall can need it this that these those i you he she we they"
).split()

# The shorter list used when a split topic is described.
SPLIT_COMMON_WORDS = "the a an and or but in on at to".split()

# Spark's English stop-word list without the entries that contain an apostrophe.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now would could ought "
    "cannot"
).split()

# Sentiment words that must not contradict a topic's dominant sentiment; also the default lexicon.
POSITIVE_WORDS = (
    "excellent great amazing good best wonderful perfect outstanding fantastic love satisfied happy impressed"
).split()
NEGATIVE_WORDS = (
    "poor bad terrible worst awful disappointed issue problem complain wrong failed broken horrible"
).split()

# Words kept in capitals in a title, and small words kept in lower case.
TITLE_ACRONYMS = (
    "AI ML NLP API SQL GPU CPU FAQ KPI OKR CRM IT HR PR SEO SEM ROI B2B B2C SaaS UI UX iOS AWS REST HTTP JSON "
    "XML CSV PDF URL HTML CSS JS PHP NoSQL CI CD"
).split()
TITLE_SMALL_WORDS = "a an and or but for nor on at to by in of the with from into onto upon as vs".split()

# Placeholder names inside square brackets that are masked out of a text.
MASK_NAMES = "name email phone address ssn number date location organization person".split()

# Words too common to tell two labels apart.
LABEL_COMMON_WORDS = "help buy question new order phone customer service product support".split()

# Lead-ins dropped from a generated summary, in the order they are tried.
SUMMARY_LEAD_INS = [
    "Answer:", "answer:", "Based on analysis", "based on analysis", "According to", "according to",
    "The documents show", "The users are saying", "Users are saying", "In this topic",
    "Summary:", "summary:", "Here is", "here is",
]

# Lines that open an answer when a response has no marker.
ANSWER_OPENERS = ["based on", "according to", "the documents show", "analysis reveals"]

# Texts that mark a label as a placeholder in the strict label format.
LABEL_PLACEHOLDERS = [
    "[label]", "[your", "your label", "descriptive label", "label here", "topic name", "[insert", "placeholder",
    "based on documents", "[", "]", "specific label", "various", "documents only",
]

# Documents shown per topic, by context size of the model in tokens.
DOCS_BY_CONTEXT = {4096: 8, 8192: 15, 131072: 100}

# White space as Unicode defines it, and what separates words.  Both patterns mean the same in Java and RE2.
WHITESPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
