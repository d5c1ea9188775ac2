"""Writers: tables, messages, contact cards and reports."""
