"""Schemas and constants that several modules use."""

from __future__ import annotations

from pyspark.sql import types as T

# The taxonomy's keys and names, thresholds, caps and word lists that results depend on.
CATEGORIES = (
    ("product_quality_and_performance", "Product Quality & Performance"),
    ("product_not_as_described", "Not As Described"),
    ("delivery_and_fulfilment", "Delivery & Fulfilment"),
    ("wait_times_and_delays", "Wait Times & Delays"),
    ("service_quality", "Service Quality"),
    ("support_responsiveness", "Support Responsiveness"),
    ("billing_and_payments", "Billing & Payments"),
    ("pricing_and_value", "Pricing & Value"),
    ("refunds_and_returns", "Refunds & Returns"),
    ("account_and_access", "Account & Access"),
    ("app_and_technical_issues", "App & Technical Issues"),
    ("booking_and_scheduling", "Booking & Scheduling"),
    ("facilities_and_environment", "Facilities & Environment"),
)
LABELS = ("negative", "neutral", "positive")
UNCLASSIFIED = "Unclassified / Emerging Complaint"
CATEGORY_THRESHOLD, SHORTLIST, TOP_CANDIDATES = 0.35, 6, 3
FETCH_K, FETCH_K_FILTERED, MMR_K, MMR_LAMBDA = 20, 50, 5, 0.5
MAX_TEXT_CHARS, MAX_EXTERNAL_ID_CHARS, MAX_PLATFORM_CHARS, MAX_ROWS, MAX_STORED_ERRORS = 20_000, 200, 100, 50_000, 100
OFF_TOPIC = ("weather", "politics", "sports", "recipe", "coding", "write code", "poem", "story", "joke")
PLATFORM_WORDS = (("amazon", "amazon"), ("yelp", "yelp"), ("twitter", "twitter_airline"), ("airline", "twitter_airline"))
HEADER_ALIASES = {
    "text": ("text", "feedback", "comment", "review", "body"),
    "external_id": ("external_id", "id", "review_id", "ticket_id"),
    "created_at": ("created_at", "date", "created", "submitted_at", "timestamp"),
    "rating": ("rating", "score", "stars"),
    "platform": ("platform", "source", "channel"),
}
DATE_PATTERNS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd")
DETERMINERS = ("the", "a", "an", "my", "your", "our", "their", "his", "her", "its", "this", "that", "these", "those", "some", "any", "no", "every", "another", "each")
KEYWORD_STOPWORDS = (
    "they", "you", "that", "this", "she", "he", "it", "we", "i", "me", "him", "her", "them", "us", "who", "what", "which", "there", "these", "those",
    "all", "some", "any", "none", "one", "ones", "another", "others", "something", "anything", "nothing", "everything", "someone", "anyone",
    "everyone", "nobody", "somebody", "anybody", "everybody", "myself", "yourself", "himself", "herself", "itself", "ourselves", "themselves", "yourselves",
    "thing", "things", "way", "ways", "lot", "lots", "bit", "kind", "sort", "part", "parts", "case", "cases", "point", "points",
    "the", "a", "an", "my", "your", "our", "their", "his", "its", "every", "each",
)
KEYWORD_FILTER_VERSION, MIN_PHRASE_CHARS, TOP_KEYWORDS = 2, 3, 200
# End of the fixed values.

CORPUS = T.StructType(
    [T.StructField(n, t) for n, t in (("review_id", T.StringType()), ("platform", T.StringType()), ("product_category", T.StringType()), ("text", T.StringType()),
     ("cleaned_text", T.StringType()), ("rating", T.DoubleType()), ("sentiment_label", T.StringType()), ("date", T.DateType()))]
)
PRODUCT_REVIEWS = "title string, text string, rating double, timestamp bigint, asin string"
BUSINESS_REVIEWS = "text string, stars double, date string, review_id string"
TWEETS = "text string, airline_sentiment string, tweet_created string, tweet_id string"
