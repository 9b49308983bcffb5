"""Fixed values of the file catalogue. They decide results, so they are stated exactly as data."""

# Category -> (engine, extensions, targets), in catalogue order.
CATEGORIES = {
    "video": ("media",
              "mp4 mov avi mkv webm wmv flv m4v 3gp 3g2 mpg mpeg ts m2ts mts vob ogv asf f4v rm rmvb divx".split(),
              "mp4 mov avi webm gif mp3 wav m4a up2 up4 compress".split()),
    "audio": ("media",
              "mp3 wav m4a aac flac ogg oga wma opus amr aiff aif m4r m4b caf ac3 mp2 mka ape wv".split(),
              "mp3 wav m4a aac flac ogg opus m4r compress".split()),
    "image": ("image",
              "jpg jpeg jfif jpe png webp heic heif avif bmp gif tif tiff svg ico".split(),
              "jpg png webp pdf gif bmp tiff ico up2 up4 up8 compress rotr rotl".split()),
    "word": ("office", "doc docx docm dot dotx odt rtf txt".split(), "pdf docx doc odt rtf txt jpg png".split()),
    "hwp": ("hwp", "hwp hwpx".split(), "pdf docx jpg png txt".split()),
    "slide": ("office", "ppt pptx pptm pps ppsx odp".split(), "pdf pptx ppt odp jpg png".split()),
    "sheet": ("office", "xls xlsx xlsm xlsb ods csv".split(), "pdf xlsx xls ods csv".split()),
    "pdf": ("pdf", ["pdf"], "docx xlsx jpg png txt compress rotr rotl split unlock protect".split()),
}

# Enlargement factor, tool label, clockwise angle per target.
UPSCALE = {"up2": 2, "up4": 4, "up8": 8}
TOOLS = {"compress": "용량 줄이기", "rotr": "오른쪽으로 돌리기", "rotl": "왼쪽으로 돌리기", "split": "쪽 나누기",
         "merge": "하나로 합치기", "unlock": "암호 풀기", "protect": "암호 걸기"}
ROTATE = {"rotr": 90, "rotl": 270}

# Extension synonyms, targets not offered and targets added per extension.
SAME = {"jpeg": "jpg", "jfif": "jpg", "jpe": "jpg", "tif": "tiff", "heif": "heic", "oga": "ogg"}
NOT_FOR = {"svg": ["up2", "up4", "up8", "compress", "rotr", "rotl"],
           "gif": ["compress", "rotr", "rotl"], "ico": ["compress", "rotr", "rotl"]}
EXTRA_FOR = {"gif": ["mp4"]}

# Media type per extension.
MIME = {
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "aac": "audio/aac", "flac": "audio/flac",
    "ogg": "audio/ogg", "opus": "audio/ogg", "m4r": "audio/mp4", "m4b": "audio/mp4", "mp4": "video/mp4",
    "mov": "video/quicktime", "avi": "video/x-msvideo", "webm": "video/webm", "gif": "image/gif",
    "jpg": "image/jpeg", "png": "image/png", "webp": "image/webp", "ico": "image/x-icon", "bmp": "image/bmp",
    "tiff": "image/tiff", "pdf": "application/pdf", "txt": "text/plain;charset=utf-8",
    "csv": "text/csv;charset=utf-8",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "doc": "application/msword", "rtf": "application/rtf", "xls": "application/vnd.ms-excel",
    "ppt": "application/vnd.ms-powerpoint", "odt": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation", "zip": "application/zip",
}

# Head kinds (hex) and the kinds expected per extension.
SIGNATURES = {"zip": "504B", "ole": "D0CF11E0"}
EXPECTED = {"docx": "zip ole", "docm": "zip ole", "dotx": "zip ole", "xlsx": "zip ole", "xlsm": "zip ole",
            "xlsb": "zip ole", "pptx": "zip ole", "pptm": "zip ole", "ppsx": "zip ole",
            "odt": "zip", "ods": "zip", "odp": "zip", "ppt": "ole", "pps": "ole"}
ENCRYPTION_MARKER = "EncryptionInfo"  # stored as UTF-16LE

# Formats recognised by leading bytes, as (format, byte offset, hex).
MAGIC_AT = [
    ("wav", 0, "52494646"), ("m4a", 4, "66747970"), ("mp4", 4, "66747970"), ("flac", 0, "664C6143"),
    ("ogg", 0, "4F676753"), ("gif", 0, "47494638"), ("jpg", 0, "FFD8"), ("png", 1, "504E47"),
    ("webp", 8, "57454250"), ("ico", 0, "00000100"), ("pdf", 0, "25504446"), ("docx", 0, "504B"),
    ("odt", 0, "504B"), ("ods", 0, "504B"), ("odp", 0, "504B"), ("doc", 0, "D0CF11E0"),
    ("xls", 0, "D0CF11E0"), ("ppt", 0, "D0CF11E0"), ("rtf", 0, "7B5C727466"), ("bmp", 0, "424D"),
    ("m4r", 4, "66747970"), ("webm", 0, "1A45DFA3"), ("pptx", 0, "504B"), ("xlsx", 0, "504B"),
    ("zip", 0, "504B"),
]
MAGIC_TEXT = {"txt": "한글", "csv": "철수"}

# Arguments of each media conversion.
MEDIA_ARGS = {
    "mp3": "-vn -c:a libmp3lame -q:a 2",
    "wav": "-vn -c:a pcm_s16le",
    "m4a": "-vn -c:a aac -b:a 192k",
    "aac": "-vn -c:a aac -b:a 192k",
    "flac": "-vn -c:a flac",
    "ogg": "-vn -c:a libvorbis -q:a 5",
    "opus": "-vn -c:a libopus -b:a 128k",
    "m4r": "-vn -t 40 -c:a aac -b:a 192k -f ipod",
    "avi": "-c:v mpeg4 -vtag xvid -q:v 4 -pix_fmt yuv420p -c:a libmp3lame -q:a 4",
    "webm": "-c:v libvpx -deadline realtime -cpu-used 8 -crf 10 -b:v 2M -auto-alt-ref 0 -pix_fmt yuv420p "
            "-c:a libopus -b:a 128k",
    "mp4": "-c:v libx264 -preset ultrafast -crf 24 -pix_fmt yuv420p -c:a aac -b:a 160k -movflags +faststart",
    "gif": "-vf fps=10,scale='min(480,iw)':-2:flags=lanczos,split[a][b];[a]palettegen[p];[b][p]paletteuse -loop 0",
}
SHRINK_AUDIO = {
    "mp3": ("mp3", "-c:a libmp3lame -b:a 128k"),
    "m4a": ("m4a", "-c:a aac -b:a 128k"),
    "m4b": ("m4b", "-c:a aac -b:a 128k -f ipod"),
    "m4r": ("m4r", "-c:a aac -b:a 128k -f ipod"),
    "aac": ("aac", "-c:a aac -b:a 128k"),
    "ogg": ("ogg", "-c:a libvorbis -q:a 3"),
    "oga": ("ogg", "-c:a libvorbis -q:a 3"),
    "opus": ("opus", "-c:a libopus -b:a 64k"),
}
SHRINK_AUDIO_OTHER = ("mp3", "-c:a libmp3lame -b:a 128k")
_SHRINK_K = "min(1,min(1280/max(iw,ih),720/min(iw,ih)))"
SHRINK_VIDEO_ARGS = (f"-vf scale='trunc(iw*{_SHRINK_K}/2)*2':'trunc(ih*{_SHRINK_K}/2)*2' "
                     "-c:v libx264 -preset superfast -crf 28 -pix_fmt yuv420p -movflags +faststart")

# Extension written after a rotation; anything else becomes png.
ROTATED = {"jpg": "jpg", "jpeg": "jpg", "jfif": "jpg", "jpe": "jpg", "heic": "jpg", "heif": "jpg", "png": "png",
           "avif": "png", "webp": "webp", "bmp": "bmp", "tif": "tiff", "tiff": "tiff"}

# Limits of the size rules.
SHRINK_LONG, SHRINK_SHORT, PHOTO_LONG, MAX_PIXELS = 1280, 720, 2560, 64_000_000
VIDEO_LONG, VIDEO_SHORT = 3840, 2160
CSS_UNITS = {"px": 1.0, "pt": 4 / 3, "pc": 16.0, "mm": 96 / 25.4, "cm": 96 / 2.54, "in": 96.0}
LOSSLESS = ["png", "bmp", "tif", "tiff", "gif"]

# Result name suffixes and notes.
SUFFIX_COMPRESS, SUFFIX_ROTATE, SUFFIX_UNLOCK, SUFFIX_PROTECT, SUFFIX_MERGE = "_압축", "_회전", "_암호해제", "_암호", "_합침"
SUFFIX_STRENGTH = {"original": "_원본충실", "strong": "_강하게"}
NOTE_ALREADY_SMALL = "이미 작게 만들어진 파일이라 더 줄이지 못했습니다. 원본과 같은 파일입니다."

# Multi-hop routes as (engine, kind of target, [(from, to, share of progress)]).
ROUTES = [
    ("office", "image", [("office", "pdf", 0.7), ("pdf", "image", 0.3)]),
    ("hwp", "docx", [("hwp", "pdf", 0.3), ("pdf", "docx", 0.7)]),
    ("hwp", "image", [("hwp", "pdf", 0.6), ("pdf", "image", 0.4)]),
]

# Message of a failed download or script load.
LOAD_FAILURE = r"(?i)dynamically imported module|module script failed|failed to fetch|networkerror|load failed"
