"""Cross-sectional research on (date, ticker) panels, planned by Catalyst."""
