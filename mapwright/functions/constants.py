"""Word lists, lookup tables and patterns the results depend on."""

# Words that only say which domain an entity belongs to.
DOMAIN_VOCABULARY = {
    "movies": (
        "movie movies film films cinema actor actors actress actresses director directors "
        "producer producers screenwriter screenwriters writer writers cast character characters "
        "plot story stories narrative narratives screenplay screenplays script scripts show shows "
        "series episode episodes season seasons documentary documentaries animation animated "
        "sequel sequels prequel prequels remake remakes adaptation adaptations"
    ).split(),
    "music": (
        "music song songs track tracks record records recording recordings artist artists band "
        "bands singer singers vocalist vocalists musician musicians composer composers album "
        "albums single singles ep eps concert concerts live performance performances performer "
        "performers label labels discography discographies vocal vocals instrument instruments"
    ).split(),
    "restaurants": (
        "restaurant restaurants dining eatery eateries cafe cafes café cafés bar bars food meal "
        "meals dish dishes menu menus chef chefs waiter waiters waitress waitresses staff service "
        "table tables reservation reservations diner diners brunch takeout takeaway delivery"
    ).split(),
}

# Macro groups, first match wins. Movies match a whole genre.
MOVIE_MACROS = [
    ("Sci-Fi/Fantasy", ["Sci-Fi", "Fantasy"]),
    ("Action/Adventure", ["Action", "Adventure", "War", "Western"]),
    ("Thriller/Horror", ["Thriller", "Horror", "Crime", "Mystery", "Film-Noir"]),
    ("Comedy", ["Comedy", "Musical"]),
    ("Drama", ["Drama"]),
    ("Family/Animation", ["Animation", "Children's"]),
    ("Documentary", ["Documentary"]),
]

# Music and restaurant macro groups match any substring.
MUSIC_MACROS = [
    ("Rock", ["rock", "alternative", "metal", "punk"]),
    ("Pop", ["pop"]),
    ("Hip-Hop", ["hip hop", "rap"]),
    ("Electronic", ["electronic", "techno", "house", "trance"]),
    ("Jazz", ["jazz", "blues"]),
    ("Classical", ["classical"]),
]
RESTAURANT_MACROS = [
    ("Italian", ["italian", "pizza"]),
    ("Mexican", ["mexican", "tacos"]),
    ("Japanese", ["japanese", "sushi", "ramen"]),
    ("Chinese", ["chinese"]),
    ("Asian", ["thai", "vietnamese", "korean"]),
    ("American", ["burger", "american"]),
    ("Cafe", ["coffee", "cafe"]),
]

# Words ignored when a region is labelled from its text.
LABEL_STOPWORDS = (
    "the and with from that this for into about their they them there which when where while "
    "through"
).split()

# Words ignored when a region is described for naming.
NAMING_STOPWORDS = (
    "the and for with this that from into about movie film music artist restaurant restaurants "
    "very good great best favorite favourite see seen watch watched like liked love loved one two "
    "three really also much more most has have had was were are is be been being it its of to in "
    "on at as by an a or not but"
).split()

# List entries that mean "nothing known".
EMPTY_LIST_TOKENS = ["nan", "none", "null", "(no genres listed)", "no genres listed"]

# Dimension, high label, low label (None: one-ended), anchor sentences.
FEEL_AXES = [
    ("valence", "positive", "negative",
     "An experience that feels joyful, uplifting, pleasant and emotionally positive.",
     "An experience that feels sad, bleak, unpleasant and emotionally negative."),
    ("activation", "energetic", "calm",
     "An experience that feels energetic, lively, exciting and stimulating.",
     "An experience that feels calm, peaceful, relaxed and tranquil."),
    ("potency", "powerful", "gentle",
     "An experience that feels powerful, forceful, overwhelming and impactful.",
     "An experience that feels gentle, subtle, delicate and restrained."),
    ("tension", "unsettling", "comforting",
     "An experience that feels tense, unsettling, anxious and emotionally uneasy.",
     "An experience that feels comforting, safe, reassuring and emotionally soothing."),
    ("warmth", "warm", "cold",
     "An experience that feels warm, welcoming, affectionate and emotionally inviting.",
     "An experience that feels cold, distant, detached and emotionally reserved."),
    ("scale", "grand", "intimate",
     "An experience that feels grand, epic, expansive and monumental.",
     "An experience that feels intimate, personal, close and small-scale."),
    ("tone", "playful", "serious",
     "An experience that feels playful, humorous, light-hearted and fun.",
     "An experience that feels serious, solemn, grave and emotionally weighty."),
    ("familiarity", "familiar", "novel",
     "An experience that feels familiar, accessible, conventional and recognisable.",
     "An experience that feels novel, unusual, experimental and unconventional."),
    ("refinement", "refined", "raw",
     "An experience that feels polished, elegant, refined and carefully crafted.",
     "An experience that feels raw, rough, gritty and unpolished."),
    ("complexity", "complex", "simple",
     "An experience that feels complex, layered, intricate and intellectually rich.",
     "An experience that feels simple, direct, straightforward and minimal."),
    ("nostalgia", "nostalgic", None,
     "An experience that feels nostalgic, reminiscent, sentimental and connected to the past.",
     None),
    ("wonder", "wonder", None,
     "An experience that inspires wonder, awe, amazement and a sense of the extraordinary.",
     None),
    ("tenderness", "tender", None,
     "An experience that feels tender, romantic, affectionate and emotionally intimate.",
     None),
]
FEEL_DIMENSIONS = [axis[0] for axis in FEEL_AXES]

# Modality codes of a fused vector.
SOURCE_LABELS = ["none", "base", "review", "base+review"]

# Share of review meaning tried when the fusion weight is chosen.
FUSION_WEIGHTS = [0.0, 0.2, 0.35, 0.5, 0.65, 0.8, 1.0]

# Size scale of a map item.
MIN_SIZE, MAX_SIZE, SIZE_STRENGTH = 4.0, 80.0, 1.8

# The English stop words that Spark ML loads by default, written out so that SQL checks can use them.
ENGLISH_STOPWORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up",
    "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should",
    "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd", "she'd", "we'd",
    "they'd", "i'm", "you're", "he's", "she's", "it's", "we're", "they're", "i've", "we've", "you've", "they've",
    "isn't", "aren't", "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
]
