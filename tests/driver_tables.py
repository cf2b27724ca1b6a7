"""Where the tests read the driver's tables."""

SF = "/root/testdata/sf0.001"
