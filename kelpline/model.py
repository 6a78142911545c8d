"""Fixed values that results depend on: kinds, excluded places, generic folder names, phrases, caps."""

# Kind of a file by extension; program code has none.
KIND_EXTENSIONS = {
    "document": ["pdf", "doc", "docx", "txt", "rtf", "odt", "pages"],
    "spreadsheet": ["xls", "xlsx", "csv", "numbers", "ods"],
    "presentation": ["ppt", "pptx", "key", "odp"],
    "image": ["jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "ico", "tiff", "heic", "heif", "raw", "cr2", "nef"],
    "video": ["mp4", "mov", "avi", "mkv", "webm", "flv", "wmv", "m4v", "mpg", "mpeg", "3gp"],
    "audio": ["mp3", "wav", "flac", "aac", "m4a", "ogg", "wma", "aiff", "alac"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "dmg", "iso"],
    "book": ["epub", "mobi", "azw", "azw3", "fb2"],
}
# Kinds as a workspace infers them; anything else is "other".
WORKSPACE_EXTENSIONS = {
    "document": ["pdf", "doc", "docx", "txt", "md", "rtf"],
    "image": ["png", "jpg", "jpeg", "gif", "svg", "bmp", "webp"],
    "presentation": ["ppt", "pptx", "key"],
    "spreadsheet": ["xls", "xlsx", "csv", "ods"],
    "audio": ["mp3", "wav", "aac", "flac"],
    "video": ["mp4", "mov", "avi", "mkv", "webm"],
    "archive": ["zip", "rar", "tar", "gz", "7z"],
}
# Directory names that are left out wherever they stand.
EXCLUDED_DIRECTORIES = [
    "node_modules", ".git", ".svn", ".hg", "__pycache__", ".cache", ".npm", ".yarn", ".pnpm", "vendor", "build", "dist",
    ".next", ".nuxt", ".venv", "venv", "env", ".env", ".tox", "target", "out", "bin", "obj", ".idea", ".vscode", ".gradle",
    ".m2", "Pods", "DerivedData", ".Spotlight-V100", ".fseventsd", ".Trashes", ".TemporaryItems", ".DocumentRevisions-V100",
]
# Excluded path prefixes by system.
SYSTEM_PREFIXES = {
    "macos": ["/System", "/Library", "/private", "/usr", "/bin", "/sbin", "/opt", "/var", "/etc", "/tmp", "/cores", "/Volumes"],
    "macos_user": ["~/Library", "~/Applications", "~/.Trash", "~/Library/Caches", "~/Library/Containers", "~/Library/Application Support", "~/Library/Logs", "~/Library/Saved Application State"],
    "windows": ["C:\\Windows", "C:\\Program Files", "C:\\Program Files (x86)", "C:\\ProgramData", "C:\\$Recycle.Bin", "C:\\System Volume Information", "C:\\Recovery", "C:\\MSOCache"],
    "linux": ["/proc", "/sys", "/dev", "/run", "/snap", "/boot", "/lost+found"],
}
# Folder names that say nothing about their content.
GENERIC_FOLDERS = [
    "Desktop", "Downloads", "Documents", "Library", "Pictures", "Movies", "Music", "Applications", "Users", "home", "var", "tmp",
    "usr", "bin", "etc", "root", "node_modules", ".git", "__pycache__", ".cache", "dist", "build", "out", "target", "src", "lib",
    "assets", "public", "static", "images", "img", "css", "js", "scripts", "Video", "Videos", "Audio", "Audios", "Photo", "Photos",
    "Image", "Images", "Data", "Backup", "Backups", "Archive", "Archives", "Temp", "Cache", "Attachments", "Files", "Folder",
    "New Folder", "Untitled", "Misc", "Logs", "logs", "Config", "config", "Settings", "Preferences",
]
# Caps, limits and thresholds.
DAY_CAP, HOUR_CAP = 500, 200
TOP_FOLDERS, SAMPLE_NAMES, SAMPLED_FILES, NAME_LENGTH, PROMPT_LENGTH = 8, 3, 10, 35, 3000
LOW_SCORE, HIGH_CONFIDENCE = 0.3, 0.8
RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 90, "half": 180}
# Markers that deny an answer, and phrases that deny it in a comment's first sentence.
DENIALS = ["NO_ANSWER", "NO ANSWER"]
STRICT_PHRASES = [
    "DOES NOT PROVIDE", "DOES NOT CONTAIN", "DOESN'T PROVIDE", "DOESN'T CONTAIN", "NOT PROVIDE SPECIFIC", "NOT CONTAIN SPECIFIC",
    "NO SPECIFIC", "NO RELEVANT", "NOT RELEVANT", "CANNOT ANSWER", "CAN'T ANSWER", "NO INFORMATION", "NOT MENTIONED",
    "DOESN'T MENTION", "DOES NOT MENTION",
]
LENIENT_PHRASES = ["NOT RELEVANT", "DOES NOT"]
# Status codes in words.
STATUS_TEXTS = {
    "loading_model": "Starting AI model...",
    "searching": "Searching...",
    "answering": "Generating answer...",
    "direct_answer": "Generating answer...",
    "decomposing_query": "Decomposing query...",
    "merging_results": "Merging results...",
    "synthesizing_answer": "Synthesizing answer...",
}
WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
