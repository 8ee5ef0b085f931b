"""Part of gridloom; see the README."""
