"""Fixed values of session analytics: event types, weights, limits. Results depend on them exactly."""

CLICK, CART, ORDER = "clicks", "carts", "orders"
EVENT_TYPES = (CLICK, CART, ORDER)
TYPE_CODE = {CLICK: 0, CART: 1, ORDER: 2}

# Unified co-visitation: bonus of an unordered pair of event types; any other pair counts 1.
PAIR_BONUS = {
    (CLICK, CLICK): 1,
    (CLICK, CART): 3,
    (CLICK, ORDER): 4,
    (CART, CART): 6,
    (CART, ORDER): 7,
    (ORDER, ORDER): 10,
}
TOP_K, TAIL_SIZE, WINDOW_SIZE = 20, 30, 5
DAY_MS = 86_400_000

# Typed co-visitation: neighbours kept, time distance (exclusive).
TYPED = {
    "clicks": {"k": 20, "gap_ms": DAY_MS},
    "cart_order": {"k": 15, "gap_ms": DAY_MS},
    "buy2buy": {"k": 15, "gap_ms": 14 * DAY_MS},
}
CART_ORDER_WEIGHT = {CLICK: 1, CART: 6, ORDER: 3}
EXPLORE_WEIGHT = {CLICK: 1, CART: 3, ORDER: 6}
GRAPH_WEIGHT = {CLICK: 1, CART: 6, ORDER: 3}
OBJECTIVE_WEIGHT = {CLICK: 0.10, CART: 0.30, ORDER: 0.60}

NEGATIVES_PER_POSITIVE, POPULAR_SHARE = 20, 0.5

# Sessions that look human: actions a second, duration in seconds, actions.
HUMAN_MAX_RATE, HUMAN_SECONDS, HUMAN_ACTIONS, HUMAN_DURATION_SHIFT = 2.0, (1, 86_400), (2, 250), 0.1
# Bot rule: count above mean + Z standard deviations, from this many session-minutes on.
BOT_Z, BOT_LEAST_GROUPS = 3.0, 10

WATERMARK, TUMBLING, TRIGGER = "2 minutes", "1 minute", "20 seconds"
SESSION_TTL_SECONDS = 1800

# Seconds between events; a gap belongs to the bucket numbered by the breakpoints below it.
GAP_BREAKS = (1, 10, 60, 300, 1800, 7200, 21600, 43200, 86400, 172800, 345600, 604800, 864000, 1209600, 1814400)

RANK_MISSING, RECENCY_MISSING, FALLBACK_SCORE = 999, 604_800, -99.0
