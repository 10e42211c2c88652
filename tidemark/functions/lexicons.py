"""Word lists, prefixes and patterns the scores depend on."""

# Thread markers.
URGENCY_MARKERS = [
    "breaking", "urgent", "alert", "now", "immediately", "warning", "must", "watch",
]
CLAIM_MARKERS = [
    "reportedly", "rumour", "rumor", "claim", "claims", "according to", "unconfirmed", "reports",
]
DENIAL_MARKERS = [
    "false", "fake", "hoax", "debunk", "not true", "isn't true", "is not true", "no evidence",
]
QUESTION_MARKERS = [
    "?", "why", "what", "how", "really", "are you sure", "is it true", "source", "proof", "confirm",
]
UNCERTAINTY_MARKERS = [
    "reportedly", "rumour", "rumor", "unconfirmed", "alleged", "apparently", "maybe", "possibly",
    "seems", "unclear", "are you sure", "is it true", "source", "proof", "confirm", "confirmed?",
    "not sure",
]
RETWEET_PREFIXES = ["rt ", "rt@", "mt ", "mt@", "via ", "via@", '"@', "“@", "‘@"]

# Lexicons of the quick post scorer.
EMOTIONAL_WORDS = [
    "ужас", "шок", "сенсация", "невероятно", "срочно", "важно", "внимание", "скандал", "разоблачение",
]
LOGICAL_PHRASES = [
    "все знают", "никто не", "очевидно", "бесспорно", "ясно как день", "факт", "правда",
]
COORDINATION_CALLS = ["подписывайтесь", "репост", "распространите", "расскажите всем", "поделитесь"]
PROPAGANDA_PHRASES = [
    "они хотят", "нас обманывают", "скрывают правду", "запад", "власть", "режим", "оппозиция",
]
FAKE_NEWS_PHRASES = [
    "инсайд", "источник", "слив", "как стало известно", "по данным", "якобы", "говорят",
]
URGENCY_CALLS = ["срочно", "немедленно", "прямо сейчас", "сегодня же"]

# Lexicons of the deep content score.
DEEP_EMOTIONAL = [
    "ужас", "шок", "сенсация", "срочно", "важно", "внимание", "скандал", "разоблачение", "кошмар",
]
DEEP_COORDINATION = ["репост", "ретвит", "подпишись", "расскажи", "поделись", "лайкни", "отправь"]
DEEP_PROPAGANDA = ["скрывают правду", "обманывают", "заговор", "они хотят", "правду"]

# Patterns that mark a comment as manipulative.
COMMENT_PATTERNS = [
    "ужас", "кошмар", "катастрофа", "апокалипсис", "гибель", "смерть",
    "terror", "horror", "nightmare", "catastrophe", "apocalypse",
    "возмущение", "гнев", "ярость", "предательство", "обман",
    "outrage", "anger", "betrayal", "scandal",
    "срочно", "немедленно", "прямо сейчас", "urgent", "immediately", "breaking", "alert",
    "все так считают", "большинство", "каждый", "everyone", "nobody",
    "или мы или они", "выбор без выбора", "either or", "only choice",
    "скрывают правду", "заговор", "секретно", "conspiracy", "cover up",
    "репост", "ретвит", "share", "retweet", "распространи",
    "подпишись", "лайкни", "напиши", "follow", "like", "comment",
    "все вместе", "одновременно", "координация", "together", "simultaneously",
]

# Labels counted as positive.
POSITIVE_LABELS = ["rumor", "rumour"]
