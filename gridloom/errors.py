"""Errors of opening workbooks."""


class InspectorError(Exception):
    """Base of all errors that end an inspection."""


class CorruptWorkbookError(InspectorError):
    """Not a readable workbook, or missing."""


class EncryptedWorkbookError(InspectorError):
    """Password-protected, or the legacy binary format."""
