"""Test bed: the operators on the TESTDATA tables. Only this package knows those tables."""
