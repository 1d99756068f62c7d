"""Spark-native structure inference and table extraction for workbooks and other irregular grids."""

from .errors import CorruptWorkbookError, EncryptedWorkbookError, InspectorError
from .operators.bands import band_extents, split_bands
from .options import UNSET, BlockOverride, InspectionOptions, SheetOverride
from .plans.extraction import Workbooks, extract, inspect, load_dataframe
from .plans.inspection import Inspection, inspect_relations
from .results import ColumnInfo, ReadPlan, SheetResultEntry, TableResult, WorkbookResult, read_plan_to_kwargs

__all__ = ["UNSET", "BlockOverride", "ColumnInfo", "CorruptWorkbookError", "EncryptedWorkbookError", "Inspection", "InspectionOptions", "InspectorError", "ReadPlan", "SheetOverride", "SheetResultEntry", "TableResult", "WorkbookResult", "Workbooks", "band_extents", "extract", "inspect", "inspect_relations", "load_dataframe", "read_plan_to_kwargs", "split_bands"]
