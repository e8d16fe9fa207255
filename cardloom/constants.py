"""Fixed values.

These strings and patterns must equal what the landed sites and documents contain; results are wrong if they differ.
They are stated here, together and as they are, and used by name everywhere else.
"""

# --- fixed values: addresses that relative links are completed with -------------------------------------------------
JAPAN_BASE_URL = "https://www.pokemon-card.com"
HONG_KONG_BASE_URL = "https://asia.pokemon-card.com"
PLAYERS_BASE_URL = "https://players.pokemon-card.com"

# --- fixed values: country labels of the product table ---------------------------------------------------------------
JAPAN = "Japan"
HONG_KONG_EN = "Hong Kong (EN)"
HONG_KONG_ZH = "Hong Kong (ZH)"

# --- fixed values: product table columns, in file order --------------------------------------------------------------
PRODUCT_COLUMNS = (
    "country",
    "product_name",
    "price",
    "release_date",
    "code",
    "link",
    "image_url",
    "include",
    "card_only",
    "product_type",
    "beginner_flag",
    "stores_available",
    "link_card_list",
    "link_pokemon_center",
)

# --- fixed values: date texts, names with codes, parts of links --------------------------------------------------------
JAPANESE_DATE = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日"
EVENT_DATE = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
MONTH_FIRST_DATE = r"(\d{1,2})-(\d{1,2})-(\d{4})"
NAME_AND_CODE = r"^(.+)\(([^)]+)\)$"
EVENT_LINK = "/event/detail/"
DECK_LINK = "deckID"
EXPANSION_PARAMETER = "expansionCodes"
IMAGE_FOLDER = "/images/"
IMAGE_ENDINGS = (".jpg", ".png")

# --- fixed values: text patterns of the pages ------------------------------------------------------------------------
PRICE_LABEL = "建議零售價[：:]"
PRICE_UNIT = "元"
HOST_LABEL = "主催者："
POSTAL_MARK = "〒"
ADDRESS_STOP_WORDS = ("イベント", "結果", "順位", "ユーザー")
STORE_NAME_PATTERN = r"カードラボ[^\s]+|ポケモンセンター[^\s]+|トレカ[^\s]+店"
PLAYER_ID_LABEL = "プレイヤーID："
PLAYER_AREA_LABEL = "エリア："
PLAYER_NAME_END = "プ"
DECK_CODE_LABEL = "デッキコード"
DECK_CODE_OPEN_END = "】"
DECK_SCRIPT_MARK = "PCGDECK"
DECK_NAME_ENTRY = r"PCGDECK\.searchItemName\[(\d+)\]='([^']+)'"
DECK_IMAGE_ENTRY = r"PCGDECK\.searchItemCardPict\[(\d+)\]='([^']+)'"
CARD_NUMBER_PATTERN = r"\d{3}\s*/\s*\d{3}"

# --- fixed values: ranks and card classes of the tournament documents ------------------------------------------------
RANK_UNIT = "位"
FIRST_PLACE = "1位"
RANK_SUFFIXES = {"1": "st", "2": "nd", "3": "rd"}
OTHER_RANK_SUFFIX = "th"
ENERGY_MARKERS = ("エネルギー", "Energy")
UNKNOWN = "Unknown"

# --- fixed values: date sort key of undated products -----------------------------------------------------------------
UNDATED_SORT_KEY = "9999-12-31"
