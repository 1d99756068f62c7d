"""Fixed values of the inference rules."""

# Thresholds.
HEADER_SCAN_ROWS = 20
HEADER_LOOKAHEAD = 5
WEIGHT_TEXT, WEIGHT_CONSISTENT, WEIGHT_DISTINCT = 0.5, 0.3, 0.2
TIMESERIES_BONUS = 0.25
CODE_RATIO, CODE_LEAST_LABELS, CODE_MAX_LENGTH = 0.6, 3, 40
AXIS_LEAST_VALUES, AXIS_RATIO, MEASURE_RATIO = 2, 0.8, 0.8
HEADER_THRESHOLD = 0.5
SAMPLE_ROWS, SAMPLE_LEAST_COLUMNS, SAMPLE_DENSITY = 20, 1, 0.5
WIDE_LEAST_COLUMNS, WIDE_DENSE_RATIO, WIDE_LOOKAHEAD, WIDE_AXIS_ROWS = 8, 0.8, 3, 2
BLANK_RUN = 2
LOW_DENSITY = 0.3
TYPE_SAMPLE_ROWS = 200
TYPE_SUCCESS = 0.95

# Labels that mark subtotal and total rows.
SKIP_KEYWORDS = ("합계", "소계", "총계", "계", "Total", "Subtotal", "Grand Total")

# Words that name a time axis, by the rule that uses them.
AXIS_LABELS_GATE = ("date", "day", "month", "period", "quarter", "time", "year", "기간", "날짜", "년", "년도", "년월", "분기", "시점", "연도", "월", "일자")
AXIS_LABELS_BONUS = ("period", "date", "time", "year", "quarter", "month")
AXIS_TOKENS_ROWS = ("period", "date", "time", "year", "month", "quarter", "qtr")
AXIS_PARTS_ROWS = ("날짜", "일자", "기간", "시점", "연도", "년도", "분기")

# Texts that read as a missing value on load.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Forms of a point on a time axis, by the rule that uses them.
GATE_VALUE = r"^[0-9]{4}([-/.][0-9]{1,2}([-/.][0-9]{1,2})?)?$|^([0-9]{4}\s*[-/]?\s*q[1-4]|q[1-4]\s*[-/]?\s*[0-9]{4})$|^[0-9]{4}\s*년\s*[1-4]\s*분기$"
BONUS_VALUE = r"^([0-9]{4}([-/][0-9]{1,2}([-/][0-9]{1,2})?)?|[0-9]{4}\s*[Qq][1-4]|[Qq][1-4]\s*[0-9]{4})$"
_MONTH, _DAY = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
ROW_VALUE = (
    rf"^[0-9]{{4}}\s*[-/.]\s*{_MONTH}\s*([-/.]\s*{_DAY}\.?)?$"
    rf"|^[0-9]{{4}}\s*년\s*{_MONTH}\s*월(\s*{_DAY}\s*일)?$"
    rf"|^{_MONTH}\s*[-/]\s*{_DAY}\s*[-/]\s*([0-9]{{2}}|[0-9]{{4}})$"
    r"|^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|jun(e)?|jul(y)?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|nov(ember)?|dec(ember)?)\s+" + rf"{_DAY},?\s+[0-9]{{4}}$"
)
CODE_LABEL = r"^[A-Za-z0-9][A-Za-z0-9:_./-]*$"
FLOAT_TEXT = r"^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
UNNAMED = r"^Unnamed: [0-9]+(_level_[0-9]+)?$"
