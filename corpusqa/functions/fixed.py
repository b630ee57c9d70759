"""Word lists, patterns and limits that decide results."""

# English stopwords.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before "
    "being below between both but by can't cannot could couldn't did didn't do does doesn't doing "
    "don't down during each few for from further had hadn't has hasn't have haven't having he he'd "
    "he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in "
    "into is isn't it it's its itself let's me more most mustn't my myself no nor not of off on "
    "once only or other ought our ours ourselves out over own same shan't she she'd she'll she's "
    "should shouldn't so some such than that that's the their theirs them themselves then there "
    "there's these they they'd they'll they're they've this those through to too under until up "
    "very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's "
    "which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've "
    "your yours yourself yourselves"
).split()

# Regular expressions (valid in Java and RE2).
WORD_PATTERN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"  # tokens with a letter or digit
TOKEN_PATTERN = WORD_PATTERN + r"|[^\s\p{L}\p{N}]"
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
PUNCTUATION_TOKEN = r"^[#?.,&!*]+$"
LINK_PATTERN = r'<a.*?href="/([a-zA-Z/?=].*?)"'

# Question word forms, in the order they are reported.
WH_FORMS = (
    ("Why1", r"^[Ww]hy.*\?"),
    ("How1", r"^[Hh]ow.*\?"),
    ("Can1", r"^[Cc]an.*\?"),
    ("Why", r".*\s[Ww]hy.*\?"),
    ("How", r".*\s[Hh]ow.*\?"),
    ("Can", r".*\s[Cc]an.*\?"),
    ("Not", r".*'t\s.*"),
)

# Closed-class question words by tag.
WP_WORDS = ("who", "whom", "whose", "what", "which")
WRB_WORDS = ("why", "how", "where", "when")
QUESTION_TYPES = ("why", "how", "who", "where", "what", "when", "which")

# Entity label -> answer type; ORG answers carry the entity itself.
ANSWER_TYPES = {
    "LOC": "location",
    "LANG": "location",
    "PER": "person",
    "DATE": "date",
    "TIME": "date",
    "ORG": "entity",
    "MISC": "unknown",
}

# Lecture type codes.
LECTURE_TYPES = {"ls": "lecture", "ss": "seminar"}

# Limits.
SNIPPET_WORDS = 100
SNIPPET_STEP = 75
CHUNK_CHARS = 500
TERM_HITS = 100
FIELD_HITS = 10
NEIGHBORS = 40
ANSWER_THRESHOLD = 0.4
OVERLAP_THRESHOLD = 0.4
LINK_SCORE = 0.5
LINK_SUPPORT = 10
REPORT_CANDIDATES = 10

# Letters folded by the wiki cleaner.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜ"
LOWER = "abcdefghijklmnopqrstuvwxyzäöü"

# Markup removal, in order.
WIKI_STEPS = (
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"<ref[^<]*</ref>", ""),
    (r"<[^>]*>", ""),
    (r"\[http:[^\] ]*", "["),
    (r"(?i)\|thumb", ""),
    (r"(?i)\|left", ""),
    (r"(?i)\|right", ""),
    (r"(?i)\|[0-9]+px", ""),
    (r"(?i)\[\[image:[^\[\]]*\|", ""),
    (r"(?i)\[\[category:([^|\]]*)[^\]]*\]\]", "[[$1]]"),
    (r"\[\[[a-z\-]*:[^\]]*\]\]", ""),
    (r"\[\[[^|\]]*\|", "[["),
    (r"\{\{[^}]*\}\}", ""),
    (r"\{[^}]*\}", ""),
    (r"\[", ""),
    (r"\]", ""),
    (r"&[^;]*;", " "),
)

# Umlauts and digits spelled out.
SPELLED = (
    ("ä", "ae"),
    ("ö", "oe"),
    ("ü", "ue"),
    ("0", " zero "),
    ("1", " one "),
    ("2", " two "),
    ("3", " three "),
    ("4", " four "),
    ("5", " five "),
    ("6", " six "),
    ("7", " seven "),
    ("8", " eight "),
    ("9", " nine "),
)
