"""Default parameters of the operators. Every operator takes them as arguments."""

# Formats, thresholds and word lists that decide results.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")
URL_SIZES = ("square", "small", "medium", "big", "large", "original", "full")
IMAGE_SIZE = "big"
DEFAULT_EXTENSION = ".jpeg"
MAX_EXTENSION_LENGTH = 5
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
MAX_NAME_LENGTH = 200
UNTITLED = "untitled"
MAX_NAME_SUFFIX = 10001

CLIP_DIM = 512
HSV_BINS = (16, 3, 2)
HSV_WEIGHT = 1.5
HSV_BLACK_V = 30
HSV_WHITE_V = 240
HSV_GREY_S = 15
HSV_MIN_FOREGROUND = 0.05

DUPLICATE_THRESHOLD = 0.92
REVIEW_THRESHOLD = 0.85
SEARCH_K = 5
ZERO_NORM = 1e-6

PQ_SUBVECTORS = 32
PQ_BITS = 8
PROBES = 16
REBUILD_RATIO = 0.2

PHASH_SIZE = 16
PHASH_BITS = 256
PHASH_THRESHOLD = 8

CLUSTER_DEFAULT = 0.35
CLUSTER_MIN = 0.10
CLUSTER_MAX = 0.80
LINKAGE_MAX = 200
GROUP_NAME_STEM = "配色"

FEATURE_TTL_DAYS = 90
URL_HISTORY_MAX = 20
PREVIEW_IMAGES = 20
ETA_WINDOW = 20

SQUARE_FILL = (255, 255, 255)
WHITE_LEVEL = 240
WHITE_RATIO = 0.90
EDGE_SHARE = 0.05

MAIN_IMAGES = 5
DETAIL_IMAGES = 100
CLASSIFY_IMAGES = 5

TITLE_PREFIXES = ("新款", "爆款", "热卖", "推荐")
TITLE_STYLES = ("潮流", "休闲", "时尚", "经典", "街头", "复古")
TITLE_SUFFIXES = ("百搭", "时尚单品", "穿搭必备", "好物")
DEFAULT_CATEGORY = "商品"
EMPTY_FOLDER_TITLE = "(空文件夹)"

CATEGORY_FLOOR = 0.2
COLOUR_FLOOR = 0.15
STYLE_FLOOR = 0.15
UNNAMED = "未命名"

# Statuses
NEW, REVIEW, DUPLICATE = "new", "review", "duplicate"
DONE, PARTIAL = "done", "partial"

# Our own limits: rows one task may hold, and bytes a broadcast may carry.
BLOCK_ROWS = 4096
VECTOR_BLOCK_ROWS = 32_768
CHUNK_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
MAX_LABELS = 10_000
