"""Default rule lists. All are parameters of the operators that use them."""

# Ordered transcript corrections (pattern, replacement); order matters.
ASR_FIXES = [
    (r"\bRAKA\b", "RAG"),
    (r"\braka\b", "RAG"),
    (r"\brag system\b", "RAG system"),
    (r"\bretrieval[\s-]*augmented[\s-]*generat\w*\b", "RAG"),
    (r"\bfine[\s-]*tunn+ings?\b", "Fine-tuning"),
    (r"\bfine[\s-]*tuneings?\b", "Fine-tuning"),
    (r"\bfine[\s-]*tunings?\b", "Fine-tuning"),
    (r"\bfune[\s-]*tunings?\b", "Fine-tuning"),
    (r"\bfine[\s-]*tunes?\b", "Fine-tune"),
    (r"\blora\b", "LoRA"),
    (r"\bpeft\b", "PEFT"),
    (r"\bParameterficion\b", "PEFT"),
    (r"\bparameterficion\b", "PEFT"),
    (r"\bparameter[\s-]*efficient\b", "PEFT"),
    (r"\bllms\b", "LLMs"),
    (r"\bllm\b", "LLM"),
    (r"\bdestillat\w*\b", "distillation"),
    (r"\bdistilation\b", "distillation"),
    (r"\bquantisation\b", "quantization"),
    (r"\bqunatization\b", "quantization"),
    (r"\bstateic\b", "static"),
    (r"\bcompetition power\b", "compute power"),
    (r"\bcompution\b", "compute"),
    (r"\bembedings?\b", "embeddings"),
    (r"\bvector\s+d\.?b\.?\b", "vector DB"),
]

# Terms looked for, in report order.
KNOWN_TERMS = ["RAG", "Fine-tuning", "LoRA", "PEFT", "LLM", "distillation", "quantization", "embeddings"]

# Tokens that keep their capitals in caption copy.
COPY_ACRONYMS = [
    "AI", "RAG", "LLM", "LLMS", "API", "APIS", "GPU", "CPU", "SQL", "UI", "UX", "ML",
    "CEO", "CTO", "IT", "AWS", "GCP", "GDPR", "PEFT", "LORA", "NLP", "SDK", "OK",
    "HR", "DSA", "SDE", "CV", "PR", "US", "USA", "UK", "PDF", "JSON", "HTTP",
    "SEO", "SEM", "CRM", "ROI", "KPI", "B2B", "B2C", "UPI", "DM", "DMS", "CTA",
    "SaaS", "MVP", "QA", "OS", "PC", "TV", "FAQ", "URL", "RAM", "SSD",
]
PRONOUN_FORMS = ["I", "I'm", "I've", "I'll", "I'd"]

# Filler and greeting words of caption copy.
FILLER = [
    "a", "an", "the", "is", "am", "are", "was", "were", "be", "to", "of", "in", "on",
    "at", "for", "and", "or", "but", "so", "that", "this", "it", "its", "i", "you",
    "we", "they", "he", "she", "my", "your", "very", "really", "just", "thing",
    "things", "like", "basically", "actually", "then", "there", "here", "what",
    "how", "all", "about", "with", "do", "did", "does", "have", "has", "had",
]
GREETINGS = ["hi", "hello", "hey", "namaste", "guys", "everyone", "friends"]

# How spoken-case copy writes its acronyms.
SPOKEN_ACRONYMS = {
    "AI": "AI", "RAG": "RAG", "LLM": "LLM", "LLMS": "LLMs", "GDPR": "GDPR", "LORA": "LoRA",
    "PEFT": "PEFT", "API": "API", "GPU": "GPU", "CPU": "CPU", "SQL": "SQL", "CTA": "CTA",
}
SPOKEN_PRONOUNS = ["I", "I'M", "I'LL", "I'VE", "I'D"]
CAPITALISED_TREATMENTS = ["serif", "quote", "oval", "underline", "blob", "stack"]
TREATMENTS = ["plain", "mix", "serif", "quote", "oval", "underline", "blob", "stack", "tape", "chip"]

# A named figure.
MONEY = r"(\$|₹|€|£)\s?\d|\d[\d,]*\s?(lakh|crore|million|billion|percent|%)\b"

# Glossary (pattern, canonical name, subtitle); first rule of a name gives the subtitle.
TERM_RULES = [
    (r"\b(rag|raka)\s+system\b", "RAG", "retrieval over your documents"),
    (r"\b(rag|raka)\b", "RAG", "retrieve, then generate"),
    (r"\bfine[-\s]?tun(?:e|ing)\b", "Fine-tuning", "train the model on your data"),
    (r"\blora\b", "LoRA", "low-rank adaptation"),
    (r"\bpeft\b|\bparameter[-\s]?efficien", "PEFT", "train adapters, not the full net"),
    (r"\bllm\b", "LLM", "the base model"),
    (r"\bembedd", "Embeddings", "vectors for retrieval"),
    (r"\bvector\s+(db|database|store)\b", "Vector DB", "where chunks live"),
    (r"\bre-?index", "Re-index", "refresh the document store"),
    (r"\bstatic data\b", "Static data", "stable enough to train on"),
    (r"\b(latest|changing|frequently changed)\b", "Latest data", "updates without retraining"),
    (r"\bdomain\b", "Domain data", "your company's knowledge"),
    (r"\bdocuments?\b", "Documents", "source of truth for RAG"),
    (r"\bcost", "Cost", "GPU time vs retrieval"),
    (r"\b(ai interviews?|llm)\b", "AI interviews", "core LLM concepts"),
]
TERM_PRIORITY = {"RAG": 0, "Fine-tuning": 1, "LoRA": 2, "PEFT": 3, "LLM": 4}
COMPARISON = r"\b(over the|vs\.?|versus|instead of|rather than)\b"
PROCESS = r"\b(first|second|then|next|starts at|breakdown)\b"
FIGURE = r"\b(\d+(\.\d+)?\s*(%|x|k|million)?)\b"
RECENCY = r"\b(\d+\s*(?:m|h|d|w|hour|hours|day|days|min)s? ago)\b"

# Glyph names, emoji and per-kind defaults.
GLYPHS = ["search", "brain", "scale", "gear", "chart", "bolt", "docs", "loop", "target", "spark", "shield", "clock"]
EMOJI_GLYPH = {
    "📄": "docs", "🔍": "search", "🧠": "brain", "⚙️": "gear", "💰": "chart", "🔁": "loop", "📂": "docs",
    "💡": "spark", "⚖️": "scale", "🚀": "bolt", "📊": "chart", "🎯": "target", "✨": "spark", "🧩": "gear",
    "🔐": "shield", "⏱️": "clock", "📁": "docs",
}
KIND_GLYPH = {
    "vs_split": "scale", "process": "loop", "diagram": "loop", "stat": "chart", "quote": "spark",
    "topic": "target", "chip_row": "loop", "term_card": "spark", "bullets": "spark",
}

# URL clean-up.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid"]
SEARCH_HOSTS = [
    "duckduckgo.com", "bing.com", "microsoft.com", "google.com", "google.co.in",
    "accounts.google.com", "consent.google.com",
]
VIDEO_EXT = [".mp4", ".webm", ".mov", ".m4v", ".mkv"]
STREAM_EXT = [".m3u8", ".mpd"]
IMAGE_EXT = [".jpg", ".jpeg", ".png", ".webp", ".gif", ".svg", ".avif"]

# Rights lists.
REUSABLE_HOSTS = [
    "wikimedia.org", "wikipedia.org", "wikimediafoundation.org", "archive.org", "openverse.org",
    "creativecommons.org", "pexels.com", "pixabay.com", "unsplash.com", "nasa.gov", "noaa.gov",
    "usgs.gov", "nih.gov", "cdc.gov", "loc.gov", "si.edu", "metmuseum.org", "europeana.eu",
    "nappy.co", "coverr.co", "mixkit.co", "videvo.net",
]
BLOCKED_HOSTS = [
    "youtube.com", "youtu.be", "youtube-nocookie.com", "googlevideo.com", "vimeo.com", "dailymotion.com",
    "tiktok.com", "instagram.com", "cdninstagram.com", "facebook.com", "fbcdn.net", "twitter.com", "x.com",
    "twimg.com", "cnn.com", "bbc.co.uk", "bbc.com", "bbci.co.uk", "reuters.com", "apnews.com", "ap.org",
    "nytimes.com", "wsj.com", "bloomberg.com", "ft.com", "theguardian.com", "washingtonpost.com",
    "latimes.com", "forbes.com", "techcrunch.com", "theverge.com", "wired.com", "arstechnica.com",
    "ndtv.com", "indiatimes.com", "indianexpress.com", "hindustantimes.com", "news18.com",
    "gettyimages.com", "shutterstock.com", "alamy.com", "adobe.com",
]
REUSABLE_MARKERS = [
    "cc0", "cc-0", "cc by", "cc-by", "cc by-sa", "cc-by-sa", "cc by-nc", "creative commons", "public domain",
    "pdm", "wikimedia", "gnu fdl", "gfdl", "pexels license", "pixabay license", "unsplash license",
]
REJECT_MARKERS = [
    "all rights reserved", "getty", "shutterstock", "associated press", "reuters", "afp",
    "strictly for editorial", "not for commercial", "drm",
]
