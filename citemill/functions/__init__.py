"""Part of citemill; see the README for the layout."""
