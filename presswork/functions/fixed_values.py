"""Word lists, patterns and weights that results depend on.

Everything here is data, kept in its natural order.  Change a value and the
scores, fingerprints and verdicts change with it.
"""

# Words removed by text normalisation.
SITE_NAMES = ["inc42", "entrackr", "moneycontrol", "startupnews"]
AGENCY_WORDS = ["source", "image", "reuters", "pti", "ians", "et"]
READ_MORE_PHRASES = ["read more", "also read", "continue reading"]

# A paragraph holding one of these is navigation, not content.
BOILERPLATE_PHRASES = [
    "share this", "follow us", "subscribe", "advertisement",
    "related articles", "trending now", "also read", "read more",
    "terms of service", "privacy policy", "copyright",
]

# Date shapes looked for in free text.
DATE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\w+ \d{1,2}, \d{4}",
]

# Image score: substrings of the absolute, lower-cased URL.
IMAGE_SIZE_WORDS = ["large", "big", "1024", "800", "600"]
IMAGE_STORY_WORDS = ["article", "content", "story", "news"]
IMAGE_CHROME_WORDS = ["icon", "logo", "ad", "banner", "thumb"]
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp"]

# Words that raise a sentence's summary score.
SUMMARY_KEYWORDS = [
    "raises", "funding", "million", "billion", "startup", "company", "announced",
]

# Strategies in the order they are tried.
STRATEGIES = ["json_ld", "microdata", "opengraph", "html_semantic", "html_heuristic"]
FALLBACK = "fallback"

# JSON-LD / microdata types that count as an article.
ARTICLE_TYPES = ["Article", "NewsArticle", "BlogPosting"]

# Containers tried for the main text, in order.
CONTENT_SELECTORS = [
    "article", "main", '[role="main"]',
    ".content", ".post-content", ".entry-content", ".article-content",
    ".story-content", ".news-content", "#content", "#main-content",
    ".td-post-content", ".single-post-content", "#contentdata",
    ".post-body", ".article-body", ".story-body",
    ".container .content", ".wrapper .content", ".main .content",
]
SEMANTIC_CONTAINERS = ["article", "main", '[role="main"]']

# Places an article image is looked for, in order.
IMAGE_SELECTORS = [
    ".featured-image img", ".post-image img", ".article-image img",
    ".hero img", ".hero-image img", ".banner img",
    "article img", ".content img", ".post-content img",
    ".news-image img", ".story-image img", ".artImg img",
    'img[src*="jpg"], img[src*="jpeg"], img[src*="png"], img[src*="webp"]',
]

# Elements cut from a container before its paragraphs are read.
CHROME_SELECTOR = "script, style, nav, footer, .ad, .advertisement, .social-share"
# Elements cut from <body> when no container held enough text.
PAGE_FRAME_SELECTOR = "nav, sidebar, footer, .nav, .sidebar, .footer, .menu, .comments"

TITLE_SELECTORS = ["h1", ".title", ".headline", '[class*="title"]', "title"]
AUTHOR_SELECTORS = [
    ".author", ".byline", '[rel="author"]',
    ".post-author", ".article-author", '[itemprop="author"]',
]
BYLINE_SELECTOR = '.author, .byline, [itemprop="author"]'
DATE_SELECTORS = [
    ".date", ".post-date", ".article-date",
    ".published", ".timestamp", '[itemprop="datePublished"]',
]

# Duplicate reasons, in the order they are tested, with their similarity.
DUPLICATE_REASONS = [
    ("exact_url_match", 1.0),
    ("title_hash_match", 0.95),
    ("content_fingerprint_match", 0.90),
]
SIMILARITY_THRESHOLD = 0.85

# Quality gate and tiers.
MIN_QUALITY = 0.3
TIERS = [("excellent", 0.8), ("good", 0.6), ("fair", 0.4)]
LOWEST_TIER = "poor"

# Prompt text for the external summariser.
SUMMARY_PROMPT = """
Write a professional news summary in exactly 55-60 words. Focus on key facts, main players, and significance.

Title: %s
Content: %s

Requirements:
- Exactly 55-60 words
- Professional journalistic tone
- Include key numbers/amounts if mentioned
- Focus on WHO, WHAT, HOW MUCH, WHY important

Summary:
"""
