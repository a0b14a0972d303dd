"""Views, registered queries and their SQL."""
