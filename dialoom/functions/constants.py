"""Character classes, speaker markers and defaults that results depend on."""

# Fixed value: the characters that Python counts as white space, as a Java class.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS = f"[{SPACES}]"

# The colons after a marker, and the one that normalising writes.
COLON = "[：:]"
FULL_COLON = "："

# Markers of which the colon is normalised.
NORMALISED_MARKERS = ("网友", "问", "段永平", "段", "大道")

# What opens a question directly, what introduces one, and who answers.
DIRECT_MARKERS = ("网友", "问", "问题", "提问", "主持人", "观众", "Q")
CITED_MARKERS = ("文章引用", "引用")
CITED_PHRASES = ("有人说", "有人认为", "有观点认为", "据说", "听说")
ANSWER_MARKERS = ("段永平", "段", "大道")

# Prefixes that are cut from questions unless others are configured.
KNOWN_PREFIXES = ("网友", "记者", "问", "提问者", "主持人", "文章引用", "Q", "观众", "评论", "主持", "用户")

# Fixed value: characters of an unknown speaker's name before a colon, up to 20.
NAME_CHARS = "一-龥A-Za-z0-9（）【】「」《》\"、,，.。·"
NAME_LENGTH = 20

# The range counted as Chinese characters, and the quality limits.
CHINESE = "[一-龥]"
MIN_QUALITY_LENGTH = 10
MIN_CHINESE_SHARE = 0.1
