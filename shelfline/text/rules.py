"""Fixed values for the conversation text jobs.

Everything in this module must equal the dashboard's own lists and patterns for
the routing results to agree; it is stated here plainly, in the original order.
"""

# ---------------------------------------------------------------------------
# On-topic vocabulary (whitespace words, punctuation attached).
TOPIC_VOCAB = [
    "revenue", "sales", "income", "payment", "amount", "money", "profit",
    "rental", "rent", "borrow", "transaction", "checkout",
    "customer", "client", "member", "segment", "retention", "churn",
    "film", "movie", "dvd", "title", "genre", "category", "inventory", "stock", "copy",
    "store", "shop", "location", "branch",
    "forecast", "predict", "prediction", "future", "trend", "growth",
    "performance", "insight", "analysis", "analytics", "metric", "kpi",
    "recommendation", "strategy", "opportunity", "improve", "increase",
    "country", "geography", "region", "city",
    "hour", "day", "week", "month", "pattern", "peak", "busy",
    "top", "best", "worst", "highest", "lowest", "most", "least",
    "compare", "comparison", "versus", "vs", "difference",
    "staff", "employee", "manager", "summary", "report", "overview",
    "transformer", "lstm", "arima", "xgboost", "xgb", "ensemble",
    "linear", "regression", "neural", "network", "boosting", "gradient",
    "random", "forest", "decision", "tree", "moving", "average",
    "overfitting", "overfit", "overfits", "mae", "rmse", "mape", "r2",
    "confidence", "interval", "shaded", "band", "uncertainty",
    "leaderboard", "composite", "ranked", "ranking", "score",
    "accurate", "accuracy", "model", "models", "algorithm", "parameter", "parameters",
    "training", "learning", "machine", "deep", "architecture", "layer",
    "attention", "mechanism", "encoding", "positional", "head", "heads",
    "sequential", "recurrent", "epoch", "dropout", "regularization",
    "data", "history", "seasonal", "seasonality", "error", "variance",
    "change", "ubah", "ganti", "modify", "edit", "warna", "color", "colour",
    "background", "chart", "bar", "pie", "line", "theme", "dark", "light",
    "position", "move", "pindah", "size", "ukuran", "layout", "kpi",
    "show", "hide", "tampilkan", "sembunyikan", "dashboard", "widget",
]

# Edit-intent words (whole words, any case).
EDIT_WORDS = ["edit", "modify", "change", "ubah", "kecilin", "gedein", "resize", "pindah", "ganti",
              "warna", "color", "background", "theme", "chart", "layout", "sembunyikan", "hide", "show"]

# Topic tags — (substring alternation, label), in display order.
TOPIC_TAGS = [
    ("revenue|sales|income|payment", "📊 Revenue"), ("customer|retention|segment", "👥 Customers"),
    ("film|movie|category|inventory", "📦 Inventory"), ("store|compare|location", "🏪 Stores"),
    ("forecast|predict|future|trend", "🔮 Forecast"), ("country|geo|region", "🌍 Geo"),
    ("hour|day|pattern|peak", "⏱️ Patterns"), ("recommend|strategy|grow", "💡 Strategy"),
    ("edit|modify|change|add|create|style|color|design", "✏️ Code Edit"),
    ("delete|remove|hide|hapus|sembunyikan", "🗑️ Layout"),
    ("chart|bar|pie|line|scatter", "📊 Chart Type"),
]
DEFAULT_TAG = "🔍 Analysis"

# Dashboard keywords (whole words, any case) for the off-topic guard.
DASHBOARD_WORDS = [
    "revenue", "sales", "rental", "rent", "customer", "film", "movie", "dvd", "store", "forecast", "predict",
    "category", "inventory", "stock", "country", "region", "geo", "pattern", "hour", "day", "week", "staff",
    "actor", "chart", "graph", "dashboard", "insight", "trend", "profit", "income", "payment", "transaction",
    "report", "analys", "kpi", "performance", "recommend", "strategy", "compare", "top", "best", "worst",
    "highest", "lowest", "grow", "declin", "drop", "spike", "loyal", "churn", "segment", "overstock",
    "slow.mov", "turnover", "busiest", "peak", "average", "monthly", "weekly", "daily", "annual", "model",
    "lstm", "transformer", "arima", "xgboost", "mae", "rmse", "mape", "r2", "overfitting", "ensemble",
    "confidence", "leaderboard", "ranking",
]

# Instant-answer phrases, first matching entry wins (key, phrases).
ANSWER_RULES = [
    ("store_performance", ["total revenue", "store performs", "which store", "revenue store", "store better",
                           "store comparison", "store contributes", "store contribute"]),
    ("recommendations", ["recommendation", "increase sales", "boost revenue", "improve sales", "grow revenue",
                         "rekomendasi", "tingkatkan penjualan", "increase revenue"]),
    ("patterns", ["busiest hour", "best day", "peak hour", "peak day", "jam tersibuk", "hari tersibuk",
                  "busiest time", "rental pattern"]),
    ("trend", ["what caused the revenue drop", "revenue drop this month", "why did revenue drop",
               "kenapa revenue turun", "penyebab revenue turun", "compare this month", "compare month",
               "previous 3 month", "last 3 month", "3 bulan terakhir", "monthly trend analysis"]),
    ("store_analysis", ["similar revenue", "store 2 more rental", "both store", "why store", "store 1 store 2",
                        "store similar", "kenapa store"]),
    ("compare_months", ["compare month", "previous 3 month", "last 3 month", "3 bulan", "compare this month sales",
                        "previous months"]),
    ("categories", ["highest revenue category", "which categor", "top categor", "kategori tertinggi",
                    "best category", "category revenue"]),
    ("forecast", ["forecast revenue", "revenue forecast", "next 3 month", "next 6 month", "predict revenue",
                  "show forecast", "forecast next", "future revenue", "prediksi revenue", "prediksi penjualan",
                  "monthly forecast"]),
    ("__transformer", ["transformer outperform", "why transformer", "why does transformer", "transformer better",
                       "linear regression outperform", "transformer vs linear", "kenapa transformer"]),
    ("__mae", ["what is mae", "what does mae", "mae mean", "mae metric", "what is rmse", "what is mape",
               "what is r squared", "what is r2", "explain mae", "explain rmse", "metric forecast",
               "evaluation metric", "mean absolute error"]),
    ("__overfitting", ["what is overfitting", "overfitting mean", "why overfit", "model overfit", "overfit small",
                       "kenapa overfit", "apa itu overfitting"]),
    ("__confidence", ["confidence interval", "what is confidence", "interval forecast", "shaded area",
                      "band forecast", "uncertainty forecast", "kenapa ada bayangan", "what is the shaded"]),
    ("__ensemble", ["ensemble forecast", "what is ensemble", "why ensemble", "ensemble model", "combined model",
                    "average model", "why combine"]),
    ("__arima", ["what is arima", "how arima", "arima work", "arima model", "explain arima", "kenapa arima",
                 "arima vs", "arima good"]),
    ("__xgboost", ["what is xgboost", "how xgboost", "xgboost work", "xgboost model", "explain xgboost",
                   "gradient boost", "xgb model", "why xgboost"]),
    ("__more_data", ["more data", "24 month", "2 year", "if more data", "with more data", "longer data",
                     "data lebih banyak", "kalau datanya lebih", "improve forecast", "improve accuracy"]),
    ("__accuracy", ["how accurate", "forecast accurate", "is the forecast", "accuracy model", "model performance",
                    "how good", "seberapa akurat", "akurasi forecast", "mape below", "mape above"]),
    ("__lstm", ["what is lstm", "how lstm", "lstm work", "lstm model", "explain lstm", "lstm vs transformer",
                "kenapa lstm", "long short term"]),
    ("__leaderboard", ["how is ranking", "how rank", "leaderboard work", "composite score", "how composite",
                       "ranking model", "model ranking", "how is model ranked", "how is leaderboard"]),
    ("__attention", ["attention mechanism", "self attention", "multi head", "positional encoding",
                     "how transformer work", "transformer architecture", "transformer deep learning",
                     "cara kerja transformer"]),
    ("__why_decline", ["why revenue decline", "why forecast decline", "revenue turun", "why dropping",
                       "revenue decrease forecast", "prediksi turun", "forecast turun"]),
]

# The answer keys that the dashboard computes; a rule with any other key answers nothing and the
# next rule is tried.
CACHED_ANSWERS = ["store_performance", "recommendations", "patterns", "trend", "store_analysis", "compare_months",
                  "categories", "forecast"]

# Entity dictionaries (first contained entry wins).
COUNTRIES = ["india", "china", "united states", "usa", "brazil", "mexico", "indonesia", "philippines",
             "nigeria", "russia", "japan", "germany", "france", "united kingdom", "uk", "canada", "australia",
             "argentina", "egypt", "turkey", "iran", "colombia", "ukraine", "saudi arabia", "malaysia", "peru",
             "venezuela", "thailand", "south africa", "taiwan", "italy", "spain", "poland", "south korea"]
CATEGORIES = ["action", "animation", "children", "classics", "comedy", "documentary",
              "drama", "family", "foreign", "games", "horror", "music", "new", "sci-fi", "sports", "travel"]
RATINGS = ["nc-17", "pg-13", "pg", "g", "r"]

# Amount suffix multipliers of the query parser (suffix must end the number text).
AMOUNT_SUFFIXES = [("k", 1000.0), ("m", 1000000.0), ("juta", 1000000.0), ("ribu", 1000.0)]

# Routing patterns (case-insensitive).
REVERT_RE = r"\b(revert|undo|rollback|batalkan)\b"
FORECAST_NAV_RE = r"\bforecast|\bprediksi|\bfuture revenue|\bprediction|\bprojection|\bnext \d+ month"
CHART_VERB_RE = r"\b(?:create|make|add|buat|tambahkan|generate)\b"
CHART_NOUN_RE = r"\b(?:chart|graph|grafik)\b"
QUERY_VERB_RE = r"\b(?:show|list|find|get|tampilkan|cari|display)\b"
# Query branches, in the parser's order
QUERY_BRANCHES = [
    ("actor", r"\bactor|\bactress|\baktris|\bpemain|\bbintang"),
    ("customer", r"\bcustomer|\bpelanggan|\bclient"),
    ("film", r"\bfilm|\bmovie|\btitle|\bjudul"),
    ("country", r"\bcountr|\bnegara|\bgeo|\bregion|\bcity|\bkota"),
    ("category", r"\bcategor|\bgenre|\bkategori"),
]
# Chart dimensions, in the chart builder's order
CHART_DIMENSIONS = [
    ("rating", r"\brating"), ("film", r"\bfilm|\bmovie|\btitle|\bjudul"), ("customer", r"\bcustomer|\bpelanggan"),
    ("category", r"\bcategor|\bgenre"), ("country", r"\bcountr|\bnegara"), ("actor", r"\bactor|\bactress"),
    ("hour", r"\bhour|\bjam"), ("day", r"\bday|\bhari|\bweek"), ("month", r"\bmonth|\bbulan|\bmonthly"),
    ("store", r"\bstore"),
]
# Threshold patterns of the query parser: (name, branch, pattern with the number in group 1, suffix group 2)
THRESHOLDS = [
    ("min_films", "actor", r"(?:more|greater|over)\s+than\s+([\d,]+)\s+film()"),
    ("min_rentals", "actor", r"(?:rental|disewa).*(?:more|greater|over)\s+than\s+([\d,]+)()"),
    ("min_amount", "customer", r"(?:more|greater|over|above|lebih)\s+than\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta|ribu)?"),
    ("max_amount", "customer", r"(?:less|kurang|below|under)\s+than\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta|ribu)?"),
    ("min_rentals", "customer", r"rent(?:al)?s?\s+(?:more|greater|over)\s+than\s+([\d,]+)()"),
    ("min_rate", "film", r"rental\s+rate\s+(?:more|greater|over|>)\s*than\s*\$?([\d.]+)\s*()"),
    ("min_rentals", "film", r"(?:more|greater|over)\s+than\s+([\d,]+)\s*(?:time|rental)()"),
    ("max_rentals", "film", r"(?:less|fewer|under|below)\s+than\s+([\d,]+)\s*(?:time|rental)()"),
    ("min_revenue", "country", r"(?:revenue|income|pendapatan)\s+(?:more|greater|over)\s+than\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta)?"),
    ("min_customers", "country", r"customer\w*\s+(?:more|greater|over)\s+than\s+([\d,]+)()"),
    ("min_revenue", "category", r"(?:revenue|income)\s+(?:more|greater|over)\s+than\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta)?"),
]
# Second forms of three of them, tried when the first finds no amount
THRESHOLDS_ELSE = {
    ("min_amount", "customer"): r"(?:spend|spent|cost|bayar)\s*(?:more|>)\s*\$?([\d,]+(?:\.\d+)?)\s*(k|m|juta|ribu)?",
    ("min_rate", "film"): r"rate\s*>\s*\$?([\d.]+)\s*()",
    ("min_rentals", "film"): r"(?:rented|disewa)\s+(?:more|greater|over)\s+than\s+([\d,]+)\s*()",
}

# Chart and query commands — row limit, sort direction, measure, film flags.
LIMIT_RE, DEFAULT_LIMIT = r"top\s+(\d+)", 15
ASCENDING_RE = "least|lowest|fewest|bottom|asc"
BY_REVENUE_RE = "revenue|income|pendapatan"
OVERSTOCK_RE = "overstock|over.?stock|too many cop|banyak copy"
SLOW_RE = r"\bslow|\bunderperform|\bsedikit disewa|\bjarang"
# The KPI command and its suffixes; the first suffix whose letters occur in the captured number
# counts, so "rb" counts as "b".
KPI_RE = (r"(?:set|ubah|ganti|change|update|jadikan)\s+(revenue|rental|customer|avg|transaction|total)\s+(?:to|jadi|ke|menjadi|=)\s*\$?"
          r"([\d,.]+\s*(?:m|million|juta|b|billion|k|thousand|rb|ribu)?)")
KPI_SUFFIXES = [("b|billion", 1e9), ("m|million|juta", 1e6), ("k|thousand|rb|ribu", 1e3)]

# Route names in decision order.
ROUTES = ["revert", "instant", "chart", "direct_query", "off_topic", "agent"]

# History sizes: chat keeps the last 12 turns; the agent takes the last 4 and
# then keeps only user/assistant ones.
CHAT_HISTORY = 12
AGENT_HISTORY = 4
AGENT_ROLES = ["user", "assistant"]
